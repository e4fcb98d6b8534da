"""Secret scans: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order models over characters are trained from labelled samples: what the fixed patterns
find are random strings, the other long tokens of the same texts are ordinary identifiers. A token
that holds a letter is added where its log-likelihood ratio per character, random against ordinary,
is high enough; of a token that a fixed pattern found in part, the rest is a token.

Only column expressions: each text is searched in place, and nothing but the tokens moves. The
models are two tables of at most 68 x 68 counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.base import settle
from postsieve.llm.spans import beside, found, masked, once

# fixed values: the base patterns; a match of a kind is a secret only if it is long enough.
# "access" and "hex" have their least lengths in the pattern: a run that is too short holds no
# shorter one that isn't
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
)
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
TOKEN = r"[A-Za-z0-9+/_=.-]{12,}+"

#: Least length of an added token, and its least mean log-likelihood ratio per pair of characters.
LEAST_TOKEN = 16
LEAST_RATIO = 0.5
PRIOR = 20
#: Tokens of either label that the models are fitted on, at most, picked by hash.
MAX_SAMPLES = 20_000
MARK = "[secret]"


def base_spans(text: Column) -> list[Column]:
    """Arrays of the assign, access and hex spans of a text."""
    assign = F.filter(
        found(text, ASSIGN, text.rlike(r"[:=]")),
        lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= ASSIGN_LEAST,
    )
    return [assign, found(text, ACCESS, text.contains("AKIA")), found(text, HEX)]


def _pairs(token: Column) -> Column:
    """Index of each pair of neighbouring characters in a table over the alphabet; others are left out."""
    chars = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.filter(
        F.zip_with(
            F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n),
            lambda a, b: F.when((a >= 0) & (b >= 0), a * len(ALPHABET) + b),
        ),
        lambda i: i.isNotNull(),
    )


def train(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> list[float]:
    """Log-likelihood ratio of each pair of characters, from rows of (token, label).

    label 1: random strings, 0: ordinary identifiers. At most `max_samples` tokens of each label
    are used, those of least hash, so that the choice is the same in each run. What follows a character
    is counted with a prior of `PRIOR` characters as they are overall, and these with one of
    each; without samples of a label its model is uniform.
    """
    one = samples.where(F.col("token").isNotNull()).select("token", "label").distinct()
    picked = None
    for label in (0, 1):
        part = one.where(F.col("label") == label).orderBy(F.xxhash64("token"), "token").limit(max_samples)
        picked = part if picked is None else picked.unionAll(part)
    picked = settle(picked, "secret_samples")
    model = _counted(picked)
    # unnamed secrets are among the ordinary tokens: those nearer to the random strings are left out of a second fit
    means = {r["label"]: r["mean"] for r in picked.groupBy("label").agg(F.avg(ratio(F.col("token"), model)).alias("mean")).collect()}
    if len(means) < 2:
        return model
    return _counted(picked.where((F.col("label") == 1) | (ratio(F.col("token"), model) < (means[0] + means[1]) / 2)))


def _counted(samples: DataFrame) -> list[float]:
    # at most 2 * 68 * 68 rows, whatever the input
    size = len(ALPHABET)
    counts = samples.select("label", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("label", "pair").count()
    tables = [[0.0] * (size * size) for _ in range(2)]
    for row in counts.collect():
        tables[row["label"]][row["pair"]] += row["count"]
    logs = []
    for table in tables:
        second = [sum(table[b::size]) for b in range(size)]
        overall = [(n + 1) / (sum(second) + size) for n in second]
        for a in range(size):
            after = table[a * size:(a + 1) * size]
            logs += [math.log((n + PRIOR * p) / (sum(after) + PRIOR)) for n, p in zip(after, overall)]
    half = size * size
    return [logs[half + i] - logs[i] for i in range(half)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per pair of a token's characters; 0 for tokens without pairs."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    pairs = _pairs(token)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, i: acc + F.element_at(table, i + 1))
    return total / F.greatest(F.size(pairs), F.lit(1))


def scan(
    docs: DataFrame, *, text: str = "text", keep: list[str] = (), least_token: int = LEAST_TOKEN,
    least_ratio: float = LEAST_RATIO, max_samples: int = MAX_SAMPLES, model: list[float] | None = None,
) -> DataFrame:
    """One row per document: `keep` columns and the arrays `assign`, `access`, `hex`, `markov`.

    Spans are (start, end, match, spaces), start and end in code points, end exclusive; spaces is
    null. The base kinds come from the fixed patterns and are independent of each other; `markov`
    spans never overlap a base span. The work grows with a text's length and matches. A null or empty text has no spans; equal rows get equal spans; an empty
    table gives an empty result; columns of the input other than `keep` are not read.
    `model`: one fitted before, else it is fitted on this table's own tokens (see `train`).
    """
    searched = _search(docs, text, keep)
    if model is None:
        # written once, read to fit the models and again to apply them
        searched = settle(searched, "secret_spans")
        model = _fit(searched, max_samples)
    added = F.filter(
        "token",
        lambda t: (F.length(t["match"]) >= least_token) & t["match"].rlike("[A-Za-z]")
        & (ratio(t["match"], model) >= least_ratio),
    )
    return searched.select(*keep, "assign", "access", "hex", added.alias("markov"))


def fit(docs: DataFrame, *, text: str = "text", max_samples: int = MAX_SAMPLES) -> list[float]:
    """The models of a table's own tokens, see `train`."""
    return _fit(settle(_search(docs, text, []), "secret_spans"), max_samples)


def _search(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    assign, access, hexes = base_spans(F.col(text))
    base = docs.select(
        *keep, F.col(text).alias("_searched"), assign.alias("assign"), access.alias("access"), hexes.alias("hex")
    )
    return base.select(*keep, "assign", "access", "hex", _tokens(F.col("_searched")).alias("token"))


def _tokens(text: Column) -> Column:
    """Tokens beside the base spans."""
    def part(p: Column) -> Column:
        return F.transform(found(p["text"], TOKEN), lambda t: F.struct(
            (p["start"] + t["start"]).alias("start"), (p["start"] + t["end"]).alias("end"),
            t["match"].alias("match"), t["spaces"].alias("spaces"),
        ))

    return once(F.concat("assign", "access", "hex"), lambda spans: F.when(F.size(spans) == 0, found(text, TOKEN)).otherwise(
        F.flatten(F.transform(beside(text, spans), part))
    ))


def _fit(searched: DataFrame, max_samples: int) -> list[float]:
    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["match"], ASSIGN_VALUE, 1)),
        F.transform(F.concat("access", "hex"), lambda s: s["match"]),
    )
    samples = F.concat(
        F.transform(values, lambda v: F.struct(v.alias("token"), F.lit(1).alias("label"))),
        F.transform("token", lambda t: F.struct(t["match"].alias("token"), F.lit(0).alias("label"))),
    )
    return train(searched.select(F.explode(samples).alias("s")).select("s.token", "s.label"), max_samples)


def redact(docs: DataFrame, *, text: str = "text", length: str | None = None, mark: str = MARK, **options) -> DataFrame:
    """The same rows and columns, every secret in `text` replaced by `mark`.

    Null and empty texts stay as they are. `length`: a column that gets the new length in code
    points where the text changed.
    """
    # fitted first, so that the texts are searched a second time but never written on the way
    model = fit(docs, text=text)
    whole = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    spotted = scan(whole, text="_text", keep=["_row"], model=model, **options)
    body = F.col("_row").getField(text)
    new = masked(body, F.concat("assign", "access", "hex", "markov"), mark)
    done = spotted.select(F.col("_row"), new.alias("_new"))
    return done.select(*[
        F.col("_new").alias(c) if c == text
        else F.when(F.col("_new") != body, F.length("_new").cast(docs.schema[c].dataType))
        .otherwise(F.col("_row").getField(c)).alias(c) if c == length
        else F.col("_row").getField(c).alias(c)
        for c in docs.columns
    ])
