"""The two places where a user's own Python runs on executors: an answering model and a text
encoder. Functions sent to executors are closures over plain values, so nothing but the
user's function has to be importable there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims, schemas

MODEL = "model"


def _contract() -> str:
    buckets = "\n".join(
        f"- {name}: {', '.join(words)}" for name, words in dims.CATEGORY_KEYWORDS.items()
    )
    return (
        f"Answer with one JSON object and nothing else. Its keys: {', '.join(schemas.RESPONSE_KEYS)}.\n"
        "company: who is hiring. min_exp, max_exp: bounds on the years of experience asked for, "
        f"{dims.NO_EXPERIENCE[0]} where none is given.\n"
        "overall: the bucket that fits best; primary, secondary: the two main buckets. Buckets "
        f"and typical words:\n{buckets}\n"
        "citizenship_required (US citizens only), security_clearance_required: false unless the "
        "text says so. visa_sponsorship: true unless the text refuses it.\n\nText of the posting:\n"
    )


def prompt(jd: Column) -> Column:
    """Question to the model: the answer's contract, then the posting text."""
    return F.concat(F.lit(_contract()), jd)


@dataclass(frozen=True)
class Model:
    """A user's answering model (a list of prompts to a list of answers) and how it may be called.

    A call that raises is taken for a limit or an outage: before the next one the worker waits `first_wait`
    seconds, twice as long after each further failure up to `longest_wait`, less a random part;
    a call that succeeds ends the row of failures. `calls_per_minute` bounds what one task calls in
    any minute (so times the tasks that run at once); None sets no bound. All waits are bounded: a prompt is
    sent `max_attempts` times at most. `clock`, for tests, has now(), sleep(seconds) and jitter(), the share of
    a wait that is left out.
    """

    answer: Callable[[list[str]], list[str | None]]
    max_attempts: int = 5
    batch_size: int = 32
    first_wait: float = 1.0
    longest_wait: float = 60.0
    calls_per_minute: int | None = None
    clock: object | None = None


def asker(model: Model) -> Callable[[list[str]], list[tuple[str | None, str | None]]]:
    """A function from prompts to (answer, error) pairs that keeps to the model's terms across its calls."""
    # plain values: what is sent to executors names nothing of this module
    answer, max_attempts = model.answer, model.max_attempts
    first_wait, longest_wait, budget = model.first_wait, model.longest_wait, model.calls_per_minute
    now, sleep, jitter = _times(model.clock)
    recent: list[float] = []
    failures = [0]

    def is_object(text):
        import json

        if text is None:
            return False
        try:
            return isinstance(json.loads(text[text.index("{"): text.rindex("}") + 1]), dict)
        except ValueError:
            return False

    def wait_for_turn():
        if failures[0]:
            wait = min(longest_wait, first_wait * 2 ** (failures[0] - 1))
            if wait > 0:
                sleep(wait * (1 - jitter()))
        if budget is not None:
            while recent and recent[0] <= now() - 60:
                recent.pop(0)
            if len(recent) >= budget:
                sleep(max(0.0, recent[0] + 60 - now()))
                recent.pop(0)
            recent.append(now())

    def ask(prompts):
        wait_for_turn()
        try:
            answers = list(answer(prompts))
        except Exception as error:  # the user's function may raise anything
            failures[0] += 1
            return [None] * len(prompts), f"{type(error).__name__}: {error}"
        failures[0] = 0
        if len(answers) != len(prompts):
            return [None] * len(prompts), f"{len(answers)} answers to {len(prompts)} prompts"
        return answers, None

    def ask_again(text, first, error):
        last = first
        for _ in range(max_attempts - 1):
            if is_object(last):
                return last, None
            (last,), error = ask([text])
        if is_object(last):
            return last, None
        return last, error or "no JSON object in the answer"

    def ask_all(prompts):
        answers, error = ask(prompts)
        return [ask_again(text, first, error) for text, first in zip(prompts, answers)]

    return ask_all


def _times(clock: object | None):
    if clock is not None:
        return clock.now, clock.sleep, clock.jitter

    def now():
        import time

        return time.monotonic()

    def sleep(seconds):
        import time

        time.sleep(seconds)

    def jitter():
        import random

        return random.random() / 2

    return now, sleep, jitter


def with_responses(
    df: DataFrame, answer: Callable[[list[str]], list[str | None]] | Model, jd: str = "jd", **terms
) -> DataFrame:
    """Add `response` (and `response_error`) by calling a model on batches of prompts.

    `answer` is a `Model`, or the function of one with the given `terms` (max_attempts, first_wait ...). A batch that raises
    is retried prompt by prompt, so one bad prompt costs nobody else an answer; so are
    prompts whose answer holds no JSON object. A prompt that gets none keeps its last answer and error. No row is
    lost. Calls are repeated when a task is: write or checkpoint the result before using it twice.
    """
    given = df.columns
    model = answer if isinstance(answer, Model) else Model(answer, **terms)
    # every task gets a copy of its own
    batch_size, ask_all, contract = model.batch_size, asker(model), _contract()
    # the text goes to Python once, and the contract with the function
    sent = df if jd in given else df.select(*given, F.col(jd).alias("_jd"))
    text, width = sent.columns.index(jd if jd in given else "_jd"), len(given)

    def answered(batches):
        import pyarrow as pa

        for rows in batches:
            # prompts and answers of a few rows at a time are Python's strings, whatever a batch holds
            for start in range(0, rows.num_rows, batch_size):
                part = rows.slice(start, batch_size)
                done = ask_all([None if t is None else contract + t for t in part.column(text).to_pylist()])
                extra = [pa.array([pair[i] for pair in done], pa.string()) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    part.columns[:width] + extra, names=part.schema.names[:width] + ["response", "response_error"]
                )

    schema = T.StructType(
        df.schema.fields
        + [T.StructField("response", T.StringType()), T.StructField("response_error", T.StringType())]
    )
    return sent.mapInArrow(answered, schema)


def model_failures(df: DataFrame) -> DataFrame:
    """Quarantine rows for prompts that got no usable answer."""
    return df.filter(F.col("response_error").isNotNull()).select(
        "link", F.lit(MODEL).alias("stage"), F.lit("model_failed").alias("reason"), F.col("response").alias("raw")
    )


def encoder(make_predict: Callable, batch_size: int = 64) -> Callable[[Column | str], Column]:
    """A text -> vector column function around a user's encoder.

    `make_predict` runs once per Python worker (load weights there) and returns a function from
    an array of texts to a two-dimensional array of floats.
    """
    return predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
