"""One search over one timeline, and the list of best matches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame

from .. import dims
from ..operators import scoring
from ..operators.hooks import Model
from ..operators.vector_store import Encoder
from ..sinks import names
from ..sources.pages import posting_texts
from . import steps
from .run import RunResult, in_own_folder


@in_own_folder
def search(
    pages: DataFrame,
    sightings: DataFrame,
    as_of: datetime | None,
    query: str = dims.DEFAULT_QUERY,
    location: str = dims.DEFAULT_LOCATION,
    timeline: str = dims.DEFAULT_TIMELINE,
    easy_apply: bool = False,
    suffix: str = "",
    page_count: int = 1,
    profile: DataFrame | None = None,
    scores: DataFrame | None = None,
    answer: Callable | Model | None = None,
    encoder: Encoder | None = None,
    term_index: str | None = None,
) -> RunResult:
    """The first pages of a search, as records. Repeats and unsuitable postings stay in.

    Scores are looked up in `scores`, or come from an `encoder` (only listed pages are encoded), or from the text.
    With a `term_index` (see `sources.term_index`) files of pages without the query's terms are not opened.
    """
    if scores is not None and encoder is not None:
        raise ValueError("give scores or an encoder, not both")
    found = steps.keyword_pages(pages, query, scores, term_index)
    picked = steps.listed_sightings(
        sightings, found, [(timeline, page_count)], location, easy_apply, as_of
    )
    rows = steps.described(picked, pages, page_count * dims.PAGE_SIZE, sightings, profile, answer, encoder)
    return RunResult(rows, names.search_name(query, location, timeline, easy_apply, suffix))


@in_own_folder
def recommended(
    pages: DataFrame,
    profile: DataFrame | None = None,
    scores: DataFrame | None = None,
    sightings: DataFrame | None = None,
    page_count: int = 1,
    day: date | None = None,
    answer: Callable | Model | None = None,
    encoder: Encoder | None = None,
) -> RunResult:
    """The postings that match the profile best, as records.

    With stored `scores` or an `encoder` only ids, links and scores take part in the ranking; otherwise every
    posting's text is scored against `profile` in one pass without a shuffle.
    """
    scores = steps.scores_of(pages, profile, scores, encoder)
    if scores is not None:
        scored = steps.scored_by_table(pages, scores)
    else:
        scored = scoring.with_text_score(posting_texts(pages), steps.one_profile(pages, profile))
    picked = steps.best_pages(scored, page_count)
    bound = page_count * dims.PAGE_SIZE
    if sightings is not None and "response" in sightings.columns:
        picked = steps.newest_sightings(sightings, picked, bound)
    rows = steps.described(picked, pages, bound, sightings, profile, answer)
    return RunResult(rows, names.recommended_name(day or date.today()))
