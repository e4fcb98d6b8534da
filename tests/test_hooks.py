import pytest
from pyspark.sql import functions as F

from postsieve.operators import hooks

ROWS = [(i, f"l{i}", f"text {i}") for i in range(40)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id int, link string, jd string").repartition(3)


def number(prompt):
    return int(prompt.rsplit(" ", 1)[1])


def test_prompt_states_the_contract_and_ends_with_the_text(spark):
    prompt = frame(spark).filter("id = 7").select(hooks.prompt(F.col("jd"))).first()[0]
    assert prompt.endswith("\ntext 7")
    for key in ("company", "min_exp", "max_exp", "overall", "primary", "secondary", "citizenship_required",
                "security_clearance_required", "visa_sponsorship", "N/A", "Generative AI", "risk management"):
        assert key in prompt


def test_every_row_gets_its_own_answer(spark):
    def answer(prompts):
        return ['{"n": %d}' % int(p.rsplit(" ", 1)[1]) for p in prompts]

    rows = hooks.with_responses(frame(spark), answer, batch_size=7).collect()
    assert {r["id"]: r["response"] for r in rows} == {i: '{"n": %d}' % i for i, _, _ in ROWS}
    assert all(r["response_error"] is None for r in rows)


def test_one_bad_prompt_costs_nobody_else(spark):
    def answer(prompts):
        if any(int(p.rsplit(" ", 1)[1]) == 13 for p in prompts):
            raise ValueError("thirteen")
        return ["{}"] * len(prompts)

    asked = hooks.with_responses(frame(spark), answer, batch_size=10, first_wait=0)
    failed = [(r["id"], r["response"], r["response_error"]) for r in asked.collect() if r["response_error"]]
    assert failed == [(13, None, "ValueError: thirteen")]
    assert [tuple(r) for r in hooks.model_failures(asked).collect()] == [("l13", "model", "model_failed", None)]


@pytest.mark.parametrize("good_at, answered", [(2, True), (3, True), (4, False)])
def test_attempts_are_bounded(spark, good_at, answered):
    def answer(prompts, calls={}):
        for p in prompts:
            calls[p] = calls.get(p, 0) + 1
        return ["{}" if calls[p] == good_at else "not yet %d" % calls[p] for p in prompts]

    row = hooks.with_responses(frame(spark, ROWS[:1]), answer, max_attempts=3).first()
    if answered:
        assert (row["response"], row["response_error"]) == ("{}", None)
    else:
        assert (row["response"], row["response_error"]) == ("not yet 3", "no JSON object in the answer")


def test_wrong_number_of_answers_is_an_error(spark):
    rows = hooks.with_responses(frame(spark), lambda prompts: ["{}"] * (len(prompts) + 1), max_attempts=1).collect()
    assert len(rows) == 40 and all("answers to" in r["response_error"] for r in rows)


class FakeClock:
    """Time that passes by waiting alone; remembers the waits."""

    def __init__(self, share=0.0):
        self.time, self.waits, self.share = 1000.0, [], share

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.time += seconds

    def jitter(self):
        return self.share


def failing(first, log):
    """A model whose first calls fail."""
    def answer(prompts):
        log.append(len(prompts))
        if len(log) <= first:
            raise RuntimeError("slow down")
        return ["{}"] * len(prompts)

    return answer


def test_waits_double_while_calls_fail_and_start_anew_after_one_that_works():
    log, clock = [], FakeClock()
    ask = hooks.asker(hooks.Model(failing(4, log), clock=clock, max_attempts=5))
    assert ask(["a", "b", "c"]) == [("{}", None)] * 3
    # a failed batch, three failed single calls, then one call for each prompt
    assert log == [3, 1, 1, 1, 1, 1, 1] and clock.waits == [1, 2, 4, 8]
    assert ask(["d"]) == [("{}", None)] and clock.waits == [1, 2, 4, 8]
    log, clock = [], FakeClock(share=0.25)
    ask = hooks.asker(hooks.Model(failing(9, log), clock=clock, max_attempts=5, first_wait=10, longest_wait=30))
    got = ask(["a", "b", "c"])
    assert clock.waits == [7.5, 15, 22.5, 22.5, 22.5, 22.5, 22.5, 22.5, 22.5]
    assert got == [(None, "RuntimeError: slow down"), (None, "RuntimeError: slow down"), ("{}", None)]


def test_answers_without_an_object_are_no_reason_to_wait():
    clock = FakeClock()
    ask = hooks.asker(hooks.Model(lambda prompts: ["?"] * len(prompts), clock=clock, max_attempts=3))
    assert ask(["a"]) == [("?", "no JSON object in the answer")] and clock.waits == []


def test_calls_per_minute_are_bounded():
    times, clock = [], FakeClock()

    def answer(prompts):
        times.append(clock.time)
        clock.time += 1
        return ["{}"] * len(prompts)

    ask = hooks.asker(hooks.Model(answer, clock=clock, calls_per_minute=5))
    for i in range(23):
        ask([f"p{i}"])
    assert len(times) == 23
    assert all(sum(t <= u < t + 60 for u in times) <= 5 for t in times)
    assert times[-1] - times[0] < 5 * 60 and len(clock.waits) == 4


def test_a_model_that_fails_at_first_ends_with_all_answers(spark):
    def answer(prompts, calls=[]):
        calls.append(1)
        if len(calls) <= 3:
            raise RuntimeError("slow down")
        return ["{}"] * len(prompts)

    model = hooks.Model(answer, batch_size=4, first_wait=0.01, longest_wait=0.05)
    rows = hooks.with_responses(frame(spark), model).collect()
    assert len(rows) == 40 and all((r["response"], r["response_error"]) == ("{}", None) for r in rows)


def test_encoder(spark):
    def make_predict():
        import numpy as np

        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype="float32")

        return predict

    encode = hooks.encoder(make_predict, batch_size=8)
    rows = frame(spark).select("jd", encode(F.col("jd")).alias("v")).collect()
    assert all(r["v"] == [float(len(r["jd"])), 1.0] for r in rows) and len(rows) == 40


def test_neither_prompts_nor_a_second_copy_of_the_text_are_sent_to_python(spark):
    asked = hooks.with_responses(frame(spark, ROWS + [(99, "l99", None)]), lambda prompts: ["{}"] * len(prompts), batch_size=4)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Answer with one JSON object" not in plan
    assert asked.columns == ["id", "link", "jd", "response", "response_error"] and asked.count() == 41
    # a text that is no column of its own
    nested = frame(spark).selectExpr("id", "link", "struct(jd) AS body")
    seen = hooks.with_responses(nested, lambda prompts: ['{"n": %d}' % number(p) for p in prompts], jd="body.jd").collect()
    assert {r["id"]: r["response"] for r in seen} == {i: '{"n": %d}' % i for i, _, _ in ROWS}
