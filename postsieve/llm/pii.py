"""Personal data: fixed patterns as seeds, and contexts learned from them.

The fixed patterns find emails, addresses, cards and phone numbers. Each of these seeds votes for
the two words before the word it begins in, its lexical pattern. Patterns and the values they stand before form a
bipartite graph, scored in rounds: a pattern is as sure as the share of its values that are, a
value as sure as its patterns make it. Values that sure patterns stand before, and that no fixed
pattern found, are added.

Only column expressions and joins. Each text is searched in place; only values and the few words
before them move. Scores are sums per pattern and per value, combined before each shuffle, so a
pattern or value with a third of all rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.base import row_key, settle
from postsieve.llm.spans import apart, found, masked, once, words

# fixed values: the base patterns. A start inside a run of the same characters can't succeed where
# the run's own start fails, so the lookbehinds lose nothing; \G lets a match begin where the one
# before ended
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")
# what a learned context may find: a word that holds a digit or an at sign
VALUE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"

#: Digits a value needs if it has no at sign.
LEAST_DIGITS = 5
#: Rounds of scoring; a pattern's least score; different seeds a pattern needs at least.
ROUNDS = 3
LEAST_SCORE = 0.8
LEAST_SEEDS = 5
MARK = "[private]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a string of at most 19 digits is right."""
    from_right = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))
    )
    def add(acc: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return acc + F.when(x["i"] % 2 == 0, x["d"]).when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(from_right, F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Arrays of the email, ip, card and phone spans of a text."""
    card = F.filter(
        F.filter(found(text, CARD, spaces=True), lambda s: F.length(_digits(s["match"])).between(14, 19)),
        lambda s: _luhn(_digits(s["match"])),
    )
    return [
        found(text, EMAIL, text.contains("@"), spaces=True),
        F.filter(found(text, IP, spaces=True), lambda s: s["match"].rlike(IP_PARTS)),
        card,
        F.filter(found(text, PHONE, text.contains("+"), spaces=True), lambda s: F.length(_digits(s["match"])).between(10, 15)),
    ]


def _pattern(before: Column, spaces: Column) -> Column:
    """Of words with `spaces` runs of white space before a span, the two before the span's own word:
    in lower case with digits as 0, empty where there are none."""
    def word(n: Column) -> Column:
        return F.when(n > 0, F.element_at(before, F.greatest(n, F.lit(1)))).otherwise("")

    return F.regexp_replace(F.lower(F.trim(F.concat_ws(" ", word(spaces - 1), word(spaces)))), "[0-9]+", "0")


def _with_patterns(spans: Column, before: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        _pattern(before, s["spaces"]).alias("pattern"),
    ))


def _entries(spans: Column, seed: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["pattern"].alias("pattern"), F.lower(s["match"]).alias("value"), F.lit(seed).alias("seed"),
        s["start"].alias("start"), s["end"].alias("end"),
    ))


def score_patterns(
    mentions: DataFrame, *, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS,
) -> DataFrame:
    """The sure patterns of rows (pattern, value, seed): columns pattern, score.

    A value's confidence is 1 if it is a seed anywhere, else 1 minus the product of (1 - score)
    over its patterns. A pattern's score is the mean confidence of its values, each counted once,
    times n / (n + 1) for n values. Patterns with fewer than `least_seeds` different seeds, or
    without words, are not sure.
    """
    edges = settle(
        mentions.where(F.col("pattern") != "").groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii_graph"
    )
    values = edges.groupBy("value").agg(F.max("seed").cast("double").alias("sure"))
    scores = None
    for _ in range(rounds):
        scores = (
            edges.join(values, "value").groupBy("pattern")
            .agg((F.sum("sure") / (F.count("*") + 1)).alias("score"), F.count(F.when(F.col("seed"), 1)).alias("seeds"))
        )
        scores = settle(scores.where(F.col("seeds") >= least_seeds), "pii_patterns")
        values = (
            edges.join(scores.select("pattern", "score"), "pattern", "left").groupBy("value")
            .agg(F.when(F.max("seed"), 1.0)
                 .otherwise(1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("score", F.lit(0.0)), F.lit(1e-9))))))
                 .alias("sure"))
        )
    return scores.where(F.col("score") >= least_score).select("pattern", "score")


def scan(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", keep: list[str] = (), **options) -> DataFrame:
    """One row per document: `keep` columns and the arrays `email`, `ip`, `card`, `phone`, `context`.

    Spans are (start, end, match, pattern), start and end in code points, end exclusive; of `context`
    only start and end. The work grows with a text's length and matches. The base kinds are independent of each other; `context` spans never overlap
    a base span. A null or empty text has no spans; equal rows get equal spans; an empty table gives
    an empty result; columns of the input other than `keep` are not read. `options`: see
    `score_patterns`.
    """
    email, ip, card, phone = base_spans(F.col(text))
    values = F.filter(
        found(F.col(text), VALUE, F.col(text).rlike("[0-9@]"), spaces=True),
        lambda v: v["match"].contains("@") | (F.length(_digits(v["match"])) >= LEAST_DIGITS),
    )
    spotted = docs.select(
        *keep, row_key(F.col(ident), F.col(text)).alias("_key"), F.col(text).alias("_searched"),
        email.alias("email"), ip.alias("ip"), card.alias("card"), phone.alias("phone"), values.alias("_value"),
    )
    base = F.concat(*KINDS[:4])
    fields = [*KINDS[:4], "_value"]
    # spans of a text share its words, split once
    placed = F.when(F.size(base) + F.size("_value") > 0, once(words(F.col("_searched")), lambda w: F.struct(*[
        _with_patterns(apart(F.col(k), base) if k == "_value" else F.col(k), w).alias(k) for k in fields
    ])))
    none = F.array().cast("array<struct<start:int,end:int,match:string,pattern:string>>")
    searched = settle(
        spotted.select(*keep, "_key", placed.alias("_spans"))
        .select(*keep, "_key", *[F.coalesce(F.col("_spans").getField(k), none).alias(k) for k in fields]),
        "pii_spans",
    )
    mentions = searched.where(F.size(base) + F.size("_value") > 0).select(
        "_key", F.explode(F.concat(_entries(base, True), _entries(F.col("_value"), False))).alias("m")
    ).select("_key", "m.*")
    sure = score_patterns(mentions.select("pattern", "value", "seed"), **options)
    added = (
        mentions.where(~F.col("seed")).join(sure, "pattern", "left_semi").groupBy("_key")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("context"))
    )
    added = added.select(F.col("_key").alias("_of"), "context")
    return searched.join(added, F.col("_key").eqNullSafe(F.col("_of")), "left").select(
        *keep, "email", "ip", "card", "phone",
        F.coalesce("context", F.array().cast("array<struct<start:int,end:int>>")).alias("context"),
    )


def redact(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", mark: str = MARK, **options) -> DataFrame:
    """The same rows and columns, all personal data in `text` replaced by `mark`; null and empty texts stay."""
    whole = docs.select(F.struct("*").alias("_row"), F.col(ident).alias("_id"), F.col(text).alias("_text"))
    spotted = scan(whole, ident="_id", text="_text", keep=["_row"], **options)
    ends = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]
    new = masked(F.col("_row").getField(text), F.concat(*ends), mark)
    done = spotted.select("_row", new.alias("_new"))
    return done.select(*[F.col("_new").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])
