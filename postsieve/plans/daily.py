"""The daily digest: best matches and three searches, suitable postings only, each link once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions.predicates import matches_keywords, suitable
from ..operators import records, scoring
from ..operators.hooks import Model
from ..operators.vector_store import Encoder
from ..session import settled_table
from ..sinks import names
from ..sources.pages import posting_texts
from . import steps
from .run import RunResult, in_own_folder


@in_own_folder
def daily(
    pages: DataFrame,
    sightings: DataFrame,
    as_of: datetime | None,
    query: str = dims.DEFAULT_QUERY,
    location: str = dims.DEFAULT_LOCATION,
    easy_apply: bool = False,
    yoe: int = dims.DEFAULT_YEARS,
    save: str = ".",
    profile: DataFrame | None = None,
    scores: DataFrame | None = None,
    scan_list=dims.DAILY_SCANS,
    day: date | None = None,
    answer: Callable | Model | None = None,
    encoder: Encoder | None = None,
    term_index: str | None = None,
) -> RunResult:
    """Four scans, suitability, first-seen links, arrival order.

    The searches share one read of the sightings. Where scores come from the text, the keyword
    test and the score share one read of the pages, whose narrow outcome is written as a table
    because the best-match list and the searches both start from it. With an `encoder`, texts that
    earlier runs have seen are not encoded again. With a `term_index` the searches open only files of pages that
    may hold the query's terms, unless all texts are read for their scores anyway.
    """
    scores = steps.scores_of(pages, profile, scores, encoder)
    best_count = sum(count for scan, count in scan_list if scan == dims.RECOMMENDED)
    searches = [(scan, count) for scan, count in scan_list if scan != dims.RECOMMENDED]

    if scores is not None:
        scored = steps.scored_by_table(pages, scores)
        found = steps.keyword_pages(pages, query, scores, term_index)
    else:
        scored = _one_text_pass(pages, query, profile)
        found = scored.filter("_found").select("page_id", "match_score")

    best = steps.best_pages(scored, best_count)
    if "response" in sightings.columns:
        best = steps.newest_sightings(sightings, best, best_count * dims.PAGE_SIZE, as_of)
    listed = steps.listed_sightings(
        sightings, found, searches, location, easy_apply, as_of, first_rank=1
    )
    picked = best.unionByName(listed, allowMissingColumns=True)

    bound = sum(count for _, count in scan_list) * dims.PAGE_SIZE
    rows = records.check_experience(steps.described(picked, pages, bound, sightings, profile, answer))
    usable = F.col("reason").isNull()
    rows = rows.filter(~usable | suitable(yoe))
    # first-seen among usable rows only, in one pass: page limits have left few rows by now,
    # and rejected ones go on to quarantine
    arrival = W.partitionBy("link", usable).orderBy("scan_rank", "page", "position")
    rows = rows.withColumn("_rank", F.row_number().over(arrival)).filter(~usable | (F.col("_rank") == 1))
    rows = rows.drop("_rank")
    name = names.daily_name(query, location, easy_apply, day or (as_of.date() if as_of else date.today()))
    return RunResult(rows, names.below(save, name))


def _one_text_pass(pages: DataFrame, query: str, profile: DataFrame | None) -> DataFrame:
    texts = posting_texts(pages).withColumn(
        "_found", matches_keywords(F.concat_ws(" ", "title", "jd"), query)
    )
    scored = scoring.with_text_score(texts, steps.one_profile(pages, profile))
    return settled_table(scored.select("page_id", "link", "match_score", "_found"), "scored_pages")
