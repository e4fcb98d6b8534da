"""From postings and answers to records, digests and quarantine rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import category, extract, predicates, response, text
from .once import computed_once

PARSE, SUITABILITY = "parse", "suitability"


def parse_responses(df: DataFrame, column: str = "response", legacy: bool = False) -> DataFrame:
    """Add the answer's fields as text, plus `stage` and `reason` of a problem (null if none)."""
    keys = schemas.RESPONSE_KEYS + (("age_match",) if legacy else ())
    kept = [name for name in df.columns if name not in keys]
    bodies = computed_once(df, {"_body": response.strip_fence(F.col(column))})
    body = F.col("_body")
    parsed = computed_once(bodies, {"_answer": response.parse_answer(body, legacy)})
    answer = F.col("_answer")
    # only an answer with a null needs a second look at its JSON for absent keys
    some_null = reduce(Column.__or__, (answer[key].isNull() for key in keys))
    parsed = computed_once(
        parsed, {"_absent": F.when(some_null, response.absent_keys(body, legacy)).otherwise(0)}
    )
    reason = response.answer_problem(F.col("_absent"), answer["company"])
    return (
        parsed.withColumn("reason", reason)
        .withColumn("stage", F.when(F.col("reason").isNotNull(), PARSE))
        .select(*kept, *(answer[key].alias(key) for key in keys), "stage", "reason")
    )


def type_fields(df: DataFrame) -> DataFrame:
    """Add whole years for the experience bounds and turn flags into booleans (null if neither)."""
    typed = {
        "min_exp_years": response.experience_years(F.col("min_exp")),
        "max_exp_years": response.experience_years(F.col("max_exp")),
    }
    for name in schemas.FLAGS + ("age_match",):
        if name in df.columns and df.schema[name].dataType.typeName() != "boolean":
            typed[name] = response.flag(F.col(name))
    return df.withColumns(typed)


def check_experience(df: DataFrame) -> DataFrame:
    """Mark typed rows whose minimum experience is stated but no number; for suitability runs."""
    problem = response.experience_problem(F.col("min_exp"), F.col("min_exp_years"))
    if "reason" not in df.columns:
        df = df.withColumns({"reason": F.lit(None).cast("string"), "stage": F.lit(None).cast("string")})
    return df.withColumns(
        {
            "stage": F.coalesce("stage", F.when(problem.isNotNull(), SUITABILITY)),
            "reason": F.coalesce("reason", problem),
        }
    )


def split_quarantine(df: DataFrame, raw: str = "response") -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantine rows); every row is in exactly one of the two."""
    good = df.filter(F.col("reason").isNull()).drop("stage", "reason")
    bad = df.filter(F.col("reason").isNotNull()).select("link", "stage", "reason", F.col(raw).alias("raw"))
    return good, bad


def extract_fields(df: DataFrame, jd: str = "jd") -> DataFrame:
    """Add the nine answer fields by rule from link and text, all within the row."""
    jd_col = F.col(jd)
    return classify(df, jd).withColumns(
        {
            "company": text.strip_commas(extract.company(F.col("link"))),
            "min_exp": extract.min_experience(jd_col),
            "max_exp": extract.max_experience(jd_col),
            "citizenship_required": extract.citizenship_required(jd_col),
            "security_clearance_required": extract.security_clearance_required(jd_col),
            "visa_sponsorship": extract.visa_sponsorship(jd_col),
        }
    )


def classify(df: DataFrame, jd: str = "jd") -> DataFrame:
    """Add `overall`, `primary` and `secondary` by keyword counts.

    The steps are separate projections on purpose: each array is built once and read several
    times, where an inlined one would be built again inside the lambdas.
    """
    return (
        df.withColumn("_words", text.tokens(F.col(jd)))
        .withColumn("_hits", category.keyword_hits(F.col("_words")))
        .withColumn("_categories", category.hit_categories(F.col("_hits")))
        .withColumn("_ranked", category.ranked_categories(F.col("_categories")))
        .withColumns(
            {
                "overall": category.category_at(F.col("_ranked"), 0),
                "primary": category.category_at(F.col("_ranked"), 0),
                "secondary": category.category_at(F.col("_ranked"), 1),
            }
        )
        .drop("_words", "_hits", "_categories", "_ranked")
    )


def with_age_match(df: DataFrame, low: float = 1.5, high: float = 2.0) -> DataFrame:
    """Add `age_match` from typed experience bounds."""
    return df.withColumn(
        "age_match", predicates.age_match(F.col("min_exp_years"), F.col("max_exp_years"), low, high)
    )


def raw_record(df: DataFrame, layout: str = "raw_v2") -> DataFrame:
    """The twelve columns of a raw layout; company loses its commas, the link its query
    (the older layout keeps links as they are)."""
    clean = {"company": text.strip_commas(F.col("company")), "title": text.strip_commas(F.col("title"))}
    if layout == "raw_v2":
        clean["link"] = text.normalize_link(F.col("link"))
    return df.withColumns(clean).select(*schemas.LAYOUTS[layout])


def digest(df: DataFrame, with_score: bool = False) -> DataFrame:
    """The digest columns by name: absent ones come out empty, others are left behind.

    That loses `match_score`; `with_score` appends it.
    """
    names = schemas.LAYOUTS["digest"] + (("match_score",) if with_score else ())
    return df.select(
        *(
            F.col(name) if name in df.columns else F.lit(None).cast(schemas.column_type(name)).alias(name)
            for name in names
        )
    )
