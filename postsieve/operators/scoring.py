"""Match scores of all postings against one profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text


def with_vector_score(df: DataFrame, profile: DataFrame, vector: str = "embedding") -> DataFrame:
    """Add `match_score` from a vector column. `profile` holds one row, one column: its vector.

    The profile enters as a scalar subquery: computed once, no join, and Spark fails the query
    if there is more than one row. Its size is one vector, whatever the size of `df`.
    """
    return (
        df.withColumn("_profile", profile.select(F.col(profile.columns[0])).scalar())
        .withColumn("match_score", similarity.vector_score(F.col(vector), F.col("_profile")))
        .drop("_profile")
    )


def with_text_score(df: DataFrame, profile: DataFrame, jd: str = "jd") -> DataFrame:
    """Add `match_score` from term frequencies. `profile` holds one row, one column: its text.

    The profile enters as a scalar subquery, its terms with their counts in order, computed
    once when the query runs, whatever its size; postings are scored row by row without a join
    or shuffle. A posting's terms are counted the same way and merged with them, so a row's work is linear in
    both however many words they share. A posting or profile without words scores 0.
    """
    given = F.sort_array(F.coalesce(text.tokens(F.col(profile.columns[0])), F.array().cast("array<string>")))
    terms = profile.select(given.alias("_given")).select(similarity.term_counts(F.col("_given")).alias("terms"))
    # columns of their own, so that they are not built again inside the lambdas
    norms = F.sqrt(similarity.squared_length(F.col("_terms"))) * F.sqrt(similarity.squared_length(F.col("_profile")))
    return (
        df.withColumn("_words", F.sort_array(text.tokens(F.col(jd))))
        .withColumn("_terms", similarity.term_counts(F.col("_words")))
        .withColumn("_profile", terms.scalar())
        .withColumn("_merged", similarity.merged(F.col("_terms"), F.col("_profile")))
        .withColumn(
            "match_score",
            F.coalesce(F.try_divide(similarity.merged_product(F.col("_merged")) * 100.0, norms), F.lit(0.0)),
        )
        .drop("_words", "_terms", "_profile", "_merged")
    )
