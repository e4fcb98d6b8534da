"""Vectors of posting texts that are kept between runs, so that no text is encoded twice.

A store is a folder of Parquet files with one row per content: `content` (a hash of what a posting's body
holds) and `vector`. Vectors of different encoders lie in folders of their own below it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.text import article_html
from ..session import settled_table
from ..sources.fetch import LISTED_IDS, by_ids
from ..sources.pages import posting_texts
from . import hooks

_SCHEMA = "content string, vector array<float>"


@dataclass(frozen=True)
class Encoder:
    """A user's text encoder (see `hooks.encoder`) and the folder where its vectors are kept.

    `name` stands for the weights: give it another name when they change, and texts are encoded anew.
    """

    make_predict: Callable
    store: str
    name: str = "default"
    batch_size: int = 64

    @property
    def path(self) -> str:
        return f"{self.store.rstrip('/')}/encoder={self.name}"


def content_key(html: Column) -> Column:
    """What a page's vector is kept under: a hash of the posting's body, whatever page frames it.

    It is taken from the raw body, so that the text of a known page need not be made again.
    """
    return F.sha2(article_html(html).cast("binary"), 256)


def stored(spark: SparkSession, encoder: Encoder) -> DataFrame:
    """All vectors kept so far. A content that two runs encoded at the same time is there twice."""
    try:
        return spark.read.schema(_SCHEMA).parquet(encoder.path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def contents(pages: DataFrame) -> DataFrame:
    """(page_id, content) of pages, settled: the only pass over their HTML that a run without new pages makes."""
    return settled_table(pages.select("page_id", content_key(F.col("html")).alias("content")), "contents")


def encode_unseen(pages: DataFrame, keyed: DataFrame, encoder: Encoder) -> None:
    """Encode the texts whose content the store doesn't hold, and add their vectors.

    Only ids and hashes are compared; of equal contents one page is encoded. Its text is fetched by id. Where
    most pages are new (a first run), they are encoded where they are read instead of moving
    their HTML to a join, and of equal contents each is.
    """
    spark = pages.sparkSession
    known = stored(spark, encoder).select("content").distinct()
    unseen = settled_table(
        keyed.join(known, "content", "left_anti").groupBy("content").agg(F.min("page_id").alias("page_id")), "unseen"
    )
    count = unseen.count()
    if not count:
        return
    raw = pages.select("page_id", "url", "html")
    if count <= LISTED_IDS or 2 * count < keyed.count():
        raw = by_ids(raw, unseen, "page_id")
    texts = posting_texts(raw.withColumn("content", content_key(F.col("html"))))
    _add(texts.select("content", F.col("jd").alias("text")), encoder)


def _add(texts: DataFrame, encoder: Encoder) -> None:
    encode = hooks.encoder(encoder.make_predict, encoder.batch_size)
    texts.select("content", encode(F.col("text")).alias("vector")).write.mode("append").parquet(encoder.path)


def profile_vector(profile: DataFrame, encoder: Encoder) -> DataFrame:
    """One row, one column `vector`: that of the profile's text, encoded when it is first seen.

    An empty profile has a vector like any text.
    """
    spark = profile.sparkSession
    text = F.coalesce(F.col(profile.columns[0]), F.lit(""))
    keyed = profile.select(F.concat(F.lit("profile "), F.sha2(text.cast("binary"), 256)).alias("content"), text.alias("text"))
    key = keyed.select("content").first()[0]
    kept = stored(spark, encoder).filter(F.col("content") == key)
    if kept.isEmpty():
        _add(keyed, encoder)
        kept = stored(spark, encoder).filter(F.col("content") == key)
    return kept.select("vector").limit(1)


def encoded_scores(pages: DataFrame, profile: DataFrame, encoder: Encoder) -> DataFrame:
    """(page_id, match_score) of pages by the cosine of their vector and the profile's, settled.

    Vectors are scored where they are stored; only hashes and scores are joined with pages. For a few
    pages only their vectors are read, by a pushed filter. A vector without length has no score (null).
    """
    keyed = contents(pages)
    encode_unseen(pages, keyed, encoder)
    return settled_table(_scored(keyed, profile_vector(profile, encoder), stored(pages.sparkSession, encoder)), "scores")


def _scored(keyed: DataFrame, profile: DataFrame, vectors: DataFrame) -> DataFrame:
    if keyed.limit(LISTED_IDS + 1).count() <= LISTED_IDS:
        vectors = by_ids(vectors, keyed, "content")
    scored = vectors.withColumn("_profile", profile.scalar()).select(
        "content", similarity.vector_score(F.col("vector"), F.col("_profile")).alias("match_score")
    )
    # one row per content, whatever the store holds twice
    single = scored.groupBy("content").agg(F.max("match_score").alias("match_score"))
    return keyed.join(single, "content", "left").select("page_id", "match_score")
