"""One query per operator over the test tables, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm import (
    adaptive_search,
    conversation_repair,
    fingerprints,
    mixing,
    ngram_join,
    periodic_runs,
    pieces,
    pii,
    quality_net,
    secret_scan,
    subspace_join,
    suffix_dedup,
    url_lists,
)
from postsieve.llm.base import WORD
from postsieve.llm.spans import joined


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _digest(kinds: list[tuple[str, Column]]) -> Column:
    return F.sha2(joined(kinds).cast("binary"), 256)


def q_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), words=suffix_dedup.WORDS)


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spotted = secret_scan.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = [(k, F.col(k)) for k in secret_scan.KINDS]
    return spotted.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS],
        _digest(kinds[:3]).alias("base_sha256"), joined(kinds).alias("spans"),
    )


def q_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spotted = pii.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    kinds = [(k, F.col(k)) for k in pii.KINDS]
    return spotted.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        _digest(kinds[:4]).alias("base_sha256"), joined(kinds).alias("spans"),
    )


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = quality_net.train(docs, _read(spark, sf_dir, "labels"))
    return quality_net.score(docs, net, keep=["doc_id"]).select(
        "doc_id", quality_net.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality_net.THRESHOLD).cast("int").alias("predicted"),
    )


def q_adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return adaptive_search.search(vectors, F.col("vec_id") % 20 == 0)


def q_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace_join.near_duplicates(_read(spark, sf_dir, "embeddings"))


def q_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents"))


# The tables have no fetch times and no lists, so both are made from the pages by rule: a capture's day
# from its id; for the first page of a host, entries for its domain, its host and its first path
CAPTURES_SQL = "DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT)"
FIRST_SQL = r"""
SELECT min(page_id) AS m, host FROM (
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) AS hosts
WHERE host <> '' GROUP BY host"""
ENTRIES_SQL = f"""
SELECT regexp_replace(host, '^[^.]*[.]', '') AS rule, DATE '2024-01-01' + CAST(m * 13 % 300 AS INT) AS since,
    CASE WHEN m % 2 = 0 THEN 'block' ELSE 'allow' END AS action FROM ({FIRST_SQL}) AS a
UNION ALL SELECT host, DATE '2024-01-01' + CAST(m * 31 % 300 AS INT), 'block' FROM ({FIRST_SQL}) AS b WHERE m % 3 = 0
UNION ALL SELECT host, DATE '2024-01-01' + CAST(m * 31 % 300 AS INT) + 45, 'allow' FROM ({FIRST_SQL}) AS c WHERE m % 3 = 0
UNION ALL SELECT host || '/en', DATE '2024-01-01' + CAST(m * 7 % 300 AS INT), 'block' FROM ({FIRST_SQL}) AS d WHERE m % 2 = 1"""


def q_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr(CAPTURES_SQL))
    entries = spark.sql(ENTRIES_SQL.replace("FROM pages", "FROM {pages}"), pages=pages)
    return url_lists.judge(captures, entries, keep=["page_id", "fetched"])


def q_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what is compared at the end travels as digests, so that batches hold each text and its ids once
    docs = _read(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    encoded = pieces.encode(docs, keep=["doc_id", "text_sha256"])
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    digests = encoded.select(
        "doc_id", "text_sha256", F.size("ids").cast("long").alias("n_ids"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids",
    )
    decoded = pieces.decode(digests, keep=["doc_id", "text_sha256", "n_ids", "ids_sha256"])
    back = F.sha2(F.col("text").cast("binary"), 256)
    return decoded.select(
        "doc_id", "n_ids", "ids_sha256", back.alias("decoded_sha256"), back.eqNullSafe(F.col("text_sha256")).alias("same_text")
    )


def q_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = fingerprints.edit_trial(_read(spark, sf_dir, "documents"))
    # documents whose fingerprint is another one within the radius
    near = fingerprints.near(trial).select("fingerprint", "n_near")
    return trial.join(near, "fingerprint").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"
    )


def _damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults put in by a rule, nulls as one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    fault = F.col("fault")
    return rows.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault <> 0").select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def q_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(_damaged(rows))
    every = rows.select(F.col("conv_id").alias("conv")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(repaired, F.col("conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document, by a hash of its id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    )
    n, start, period = F.size("words"), F.col("start"), F.col("period")
    placed = split.withColumn("start", F.when(n > 0, F.col("g") % n).cast("int")).withColumn(
        "period", (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int")
    )
    repeated = F.transform(
        "words", lambda word, i: F.when(i < start, word).otherwise(F.get("words", start + (i - start) % period))
    )
    return placed.select("doc_id", F.coalesce(F.array_join(repeated, " "), "text").alias("text"))


def q_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(_periodic(_read(spark, sf_dir, "documents")), keep=["doc_id"])
    # the greatest length / period, compared exactly by cross products; then the first in order
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def q_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": q_suffix_dedup,
        "op2_mixing": q_mixing,
        "op3_secrets": q_secrets,
        "op4_pii": q_pii,
        "op5_quality": q_quality,
        "op6_adaptive_search": q_adaptive_search,
        "op7_subspace_join": q_subspace_join,
        "op8_url_lists": q_url_lists,
        "op9_pieces": q_pieces,
        "op10_ngram_join": q_ngram_join,
        "op11_fingerprints": q_fingerprints,
        "op12_conversation_repair": q_conversation_repair,
        "op13_periodic_runs": q_periodic_runs,
        "pipeline": q_pipeline,
    }
