"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document has a virtual finish time: the words its source has handed out up to and
with it, in shuffled order, divided by the source's target. Taking copies in the order of these
times serves all sources at the rate of their targets; the mix ends where the total budget is used.
Each copy's time is lessened by half of its own share, so that a copy which crosses the end is taken
where that brings its source nearer to the target, and left where it doesn't.

All of it is column expressions, joins and range sorts. A source of any size is split over ranges
(`running_total`), so a hot source is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.base import n_words, running_total, settle

MAX_REPEATS = 3
MAX_SENT = 500_000
WEIGHTS = (1, 2, 3)


def targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add `target` to (source, source_size, weight): the whole of all sizes, shared by weight.

    A target stops at `max_repeats` times its source's size; what lies above is shared again by
    weight among the others until none is above. Each round is one aggregate over the sources.
    """
    sources = settle(sources, "sources")
    cap = F.col("source_size") * max_repeats
    level, before = None, -1
    while True:
        capped = F.lit(False) if level is None else cap <= F.col("weight") * level
        got = sources.agg(
            F.sum("source_size").alias("budget"),
            F.sum(F.when(capped, cap)).alias("stopped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if got["n"] == before or not got["open"]:
            break
        before, level = got["n"], ((got["budget"] or 0) - (got["stopped"] or 0)) / got["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0))).cast("double"))


def mix(
    docs: DataFrame, *, ident: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 0,
    keep: list[str] = (),
) -> DataFrame:
    """One row per document: `keep` columns, `ident`, `source`, size, source_size, target, taken, copies.

    Sources by code point, null last (null is a source of its own), get `weights` in turn. `taken`
    is the words the mix takes of a document: its size times its `copies`, at most `max_repeats`.
    Copies that have the same virtual time as the first that doesn't fit are left out with it.
    A null or empty text has size 0 and 0 words taken; copies of equal rows are dealt in any order
    between them; an empty table gives an empty result. The shuffle is a hash of `seed`, id and
    text, so reruns agree. Columns
    not named are not read.
    """
    sized = settle(
        docs.select(
            *keep, F.col(ident).alias("_id"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(ident), F.col(text)).alias("_u"),
        ),
        "sizes",
    )
    totals = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("_one"))
    ranked = running_total(totals, [F.col("_source").asc_nulls_last()], "_one", "_rank")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    wanted = targets(
        ranked.select(
            "_source", "source_size",
            F.element_at(turn, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
        ),
        max_repeats,
    ).select(F.col("_source").alias("_of"), "source_size", "target")
    shuffled = [F.col("_u"), F.col("_id").asc_nulls_last(), F.col("size")]
    served = running_total(sized, shuffled, "size", "_served", by=["_source"])
    served = settle(
        served.join(wanted, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of"), "served"
    )

    def finish(repeat: Column) -> Column:
        return F.try_divide(repeat * F.col("source_size") + F.col("_served") - F.col("size") / 2, F.col("target"))

    # repeats that can end before the cut: those begun within the target, and one more
    last = F.least(F.lit(max_repeats - 1), F.floor(F.try_divide(F.col("target"), F.col("source_size"))) + 1)
    copies = served.where((F.col("size") > 0) & (F.col("target") > 0)).select(
        "_id", "_u", "size", F.explode(F.transform(F.sequence(F.lit(0), last.cast("int")), finish)).alias("_finish")
    )
    budget = sized.agg(F.sum("size")).first()[0] or 0
    queue = running_total(copies, [F.col("_finish"), *shuffled[:2]], "size", "_total")
    cut = queue.where(F.col("_total") > budget).agg(F.min("_finish")).first()[0]
    fits = [
        F.when((F.col("size") > 0) & (F.col("target") > 0) & (r <= last)
               & (finish(F.lit(r)) < (F.lit(cut) if cut is not None else F.lit(float("inf")))), 1).otherwise(0)
        for r in range(max_repeats)
    ]
    n = sum(fits[1:], fits[0])
    return served.select(
        *keep, F.col("_id").alias(ident), F.col("_source").alias(source), "size", "source_size", "target",
        (F.col("size") * n).cast("long").alias("taken"), n.cast("int").alias("copies"),
    )


def mixed(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows and columns of `docs`, each as often as the mix takes it.

    Rows that are equal in id and text come out equally often: as often as the mix takes them on
    average, rounded. Documents without words are never taken.
    """
    whole = docs.select(
        F.struct("*").alias("_row"), F.struct(F.col(ident).alias("i"), F.xxhash64(F.col(text)).alias("h")).alias("_key"),
        F.col(ident).alias("_id_of"), F.col(text).alias("_text"), F.col(source).alias("_source_of"),
    )
    taken = mix(whole, ident="_id_of", text="_text", source="_source_of", keep=["_key"], **options)
    often = settle(
        taken.groupBy("_key").agg(F.round(F.avg("copies")).cast("int").alias("_n")).where("_n > 0")
        .select(F.col("_key").alias("_of"), "_n"),
        "mix_copies",
    )
    rows = whole.select("_row", "_key")
    # keys and counts of up to MAX_SENT documents are broadcast, some 40 bytes each
    often = F.broadcast(often) if often.count() <= MAX_SENT else often
    same = F.col("_key.i").eqNullSafe(F.col("_of.i")) & (F.col("_key.h") == F.col("_of.h"))
    return rows.join(often, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
