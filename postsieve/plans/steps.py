"""Steps the commands share.

Inputs: `pages` (page_id unique, url, html) and `sightings` (event_id unique, ts, page_id,
location, easy_apply, and `response` where a model's answers are at hand).

Shape of every plan: choose the few rows a scan lists from ids, times and scores, settle them, then
read the answers and the page text of just those ids, by filters that reach the files. Answers
are parsed where they are read; only those of unusable rows travel on, for the quarantine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims, schemas
from ..functions.predicates import window_end
from ..functions.response import experience_problem, experience_years
from ..functions.text import normalize_link, strip_commas
from ..operators import hooks, lookups, ordering, records, scans, scoring
from ..operators.filters import keyword_filter
from ..operators.vector_store import Encoder, encoded_scores
from ..session import settled_table
from ..sources.fetch import LISTED_IDS, by_ids, by_list
from ..sources.pages import posting_headings, posting_texts
from ..sources.term_index import only_files_with

# Picked rows are broadcast to fetch their pages up to this many; beyond it Spark decides.
BROADCAST_PICKS = 10_000
# Scores are ranked at this precision; closer ones are ties, broken by link.
SCORE_DIGITS = 4


def keyword_pages(
    pages: DataFrame, query: str, scores: DataFrame | None = None, term_index: str | None = None
) -> DataFrame:
    """Ids of the pages a query finds (with their scores, if given). No query, no text read.

    With a `term_index` of the files of `pages`, those that can't hold a match are not opened.
    """
    if query.split():
        searched = pages if term_index is None else only_files_with(pages, query, term_index)
        found = keyword_filter(posting_texts(searched), query)
    else:
        found = pages
    found = found.select("page_id")
    return found if scores is None else found.join(scores.select("page_id", "match_score"), "page_id", "left")


def listed_sightings(
    sightings: DataFrame,
    found: DataFrame,
    scan_list: scans.Scans,
    location: str,
    easy_apply: bool,
    as_of: datetime | None,
    first_rank: int = 0,
) -> DataFrame:
    """Sightings of found pages that the searches list on their first pages.

    A search lists its newest rows, so of any one page no more than a full list can appear.
    Sightings are thinned to that before they are joined, on the map side: a page seen all the
    time does not flood the task that joins it.
    """
    eligible = sightings.filter("easy_apply") if easy_apply else sightings
    eligible = lookups.with_geo_id(eligible).filter(F.col("geo_id") == dims.geo_id_of(location))
    eligible = eligible.select("event_id", "ts", "page_id")
    longest = max(pages for _, pages in scan_list) * dims.PAGE_SIZE
    recent = ordering.first_seen(
        scans.within_widest(eligible, scan_list, as_of), "page_id", ordering.newest_first(), longest
    )
    return scans.top_scans(recent.join(found, "page_id"), scan_list, as_of, first_rank=first_rank)


def best_pages(scored: DataFrame, page_count: int = 1, scan_rank: int = 0) -> DataFrame:
    """The best matches among (page_id, link, match_score), numbered like a scan."""
    key = F.round("match_score", SCORE_DIGITS)
    order = [key.desc_nulls_last(), F.col("link"), F.col("page_id")]
    top = ordering.listed_pages(scored.select("page_id", "link", "match_score"), order, key, page_count)
    return top.drop("link").withColumns(
        {"scan_rank": F.lit(scan_rank), "scan": F.lit(dims.RECOMMENDED)}
    )


def newest_sightings(sightings: DataFrame, picked: DataFrame, row_bound: int, as_of: datetime | None = None) -> DataFrame:
    """Picked pages with the newest sighting of each, for the answer that comes with it.

    A page that was never seen stays, without a sighting.
    """
    if as_of is not None:
        sightings = sightings.filter(F.col("ts") <= window_end(as_of))
    ids = few(picked.select("page_id"), row_bound)
    latest = ordering.first_seen(
        sightings.select("event_id", "ts", "page_id").join(ids, "page_id"), "page_id", ordering.newest_first()
    )
    return picked.join(latest, "page_id", "left")


def scores_of(
    pages: DataFrame, profile: DataFrame | None, scores: DataFrame | None, encoder: Encoder | None
) -> DataFrame | None:
    """Scores of all pages: those given, those of an encoder, or None where the text is to be scored."""
    if scores is not None and encoder is not None:
        raise ValueError("give scores or an encoder, not both")
    if encoder is not None:
        return encoded_scores(pages, one_profile(pages, profile), encoder)
    return scores


def scored_by_table(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """(page_id, link, match_score) from stored scores; the page text is not read."""
    links = pages.select("page_id", normalize_link(F.col("url")).alias("link"))
    return links.join(scores.select("page_id", "match_score"), "page_id", "left")


def one_profile(pages: DataFrame, profile: DataFrame | None) -> DataFrame:
    """The profile, or an empty one."""
    return pages.sparkSession.sql("SELECT '' AS profile") if profile is None else profile


def few(picked: DataFrame, row_bound: int) -> DataFrame:
    return F.broadcast(picked) if row_bound <= BROADCAST_PICKS else picked


def described(
    picked: DataFrame,
    pages: DataFrame,
    row_bound: int,
    sightings: DataFrame | None = None,
    profile: DataFrame | None = None,
    answer: Callable[[list[str]], list[str | None]] | hooks.Model | None = None,
    encoder: Encoder | None = None,
) -> DataFrame:
    """Picked rows with fields, score, and `stage`/`reason`/`raw` where a row is unusable.

    The fields of a row come from the answer that came with its sighting, else from calling a
    model, else from rules. A model that gave no usable answer is the reason then, with what it
    said last. Company loses its commas here, before a row is a record of any kind.
    """
    rows = picked = settled_table(picked, "picked")
    with_answers = sightings is not None and "response" in sightings.columns and "event_id" in rows.columns
    keys = ["page_id", "event_id"] if with_answers else ["page_id"]
    wanted, answers = pages.select("page_id", "url", "html"), None
    if row_bound <= LISTED_IDS:
        listed = picked.select(*keys).collect()
        wanted = by_list(wanted, (row["page_id"] for row in listed), "page_id")
        if with_answers:
            answers = by_list(sightings.select("event_id", "response"), (row["event_id"] for row in listed), "event_id")
    else:
        wanted = by_ids(wanted, picked, "page_id")
        if with_answers:
            answers = by_ids(sightings.select("event_id", "response"), picked, "event_id")

    if "match_score" not in rows.columns and encoder is not None:
        scores = encoded_scores(wanted, one_profile(pages, profile), encoder)
        rows = rows.join(few(scores, row_bound), "page_id", "left")
    scored = "match_score" in rows.columns
    silent = True
    if with_answers:
        rows = _with_answers(rows, answers, row_bound)
        # mostly every listed row has an answer, and then the text of the body is not needed for fields
        unseen = picked.filter(F.col("event_id").isNull())
        silent = not answers.filter(F.col("response").isNull()).isEmpty() or not unseen.isEmpty()
    fetched = wanted.join(few(rows, row_bound), "page_id")
    rows = posting_texts(fetched) if silent or not scored else posting_headings(fetched)
    if not scored:
        rows = scoring.with_text_score(rows, one_profile(pages, profile))
    if not with_answers:
        rows = _by_rules(rows) if answer is None else _by_model(rows, answer)
    elif not silent:
        rows = _by_answer(rows)
    elif answer is None:
        rows = _by_answer_or_rules(rows)
    else:
        said = _by_answer(rows.filter(~F.col("_silent")))
        asked = _by_model(rows.filter("_silent").drop("_silent", "stage", "reason", "raw", *_SAID.values()), answer)
        rows = said.unionByName(asked, allowMissingColumns=True)
    return rows.withColumn("company", strip_commas(F.col("company"))).drop("jd", "_silent", *_SAID.values())


_SAID = {key: f"_said_{key}" for key in schemas.RESPONSE_KEYS}


def _with_answers(picked: DataFrame, answers: DataFrame, row_bound: int) -> DataFrame:
    """Picked rows with what their answers say (`_said_...`), parsed where the answers are read.

    `_silent` are rows without an answer.
    """
    seen, unseen = picked.filter(F.col("event_id").isNotNull()), picked.filter(F.col("event_id").isNull())
    given = answers.join(few(seen, row_bound), "event_id")
    rows = given.unionByName(unseen, allowMissingColumns=True)
    silent = F.col("response").isNull()
    parsed = records.parse_responses(rows).withColumnsRenamed(_SAID).withColumn("_silent", silent)
    problem = {name: F.when(~silent, F.col(name)) for name in ("stage", "reason")}
    return _keep_raw(parsed.withColumns(problem), "response", _SAID["min_exp"]).drop("response")


def _keep_raw(rows: DataFrame, source: str, min_exp: str = "min_exp") -> DataFrame:
    """Add `raw`: the answer of a row that is unusable, or would be where its experience has to be a number."""
    unread = experience_problem(F.col(min_exp), experience_years(F.col(min_exp))).isNotNull()
    return rows.withColumn("raw", F.when(F.col("reason").isNotNull() | unread, F.col(source)))


def _by_rules(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return records.type_fields(records.extract_fields(rows)).withColumns(
        {"stage": nothing, "reason": nothing, "raw": nothing}
    )


def _by_answer(rows: DataFrame) -> DataFrame:
    return records.type_fields(rows.withColumns({key: F.col(name) for key, name in _SAID.items()}))


def _by_answer_or_rules(rows: DataFrame) -> DataFrame:
    """Fields from each row's answer, from rules where it has none, in one pass."""
    ruled = records.extract_fields(rows)
    chosen = {
        key: F.when(F.col("_silent"), F.col(key).cast("string")).otherwise(F.col(name)) for key, name in _SAID.items()
    }
    return records.type_fields(ruled.withColumns(chosen))


def _by_model(rows: DataFrame, answer: Callable | hooks.Model) -> DataFrame:
    """Fields of a model's answers; where it failed, that is the reason."""
    asked = hooks.with_responses(rows, answer)
    failed = F.col("response_error").isNotNull()
    parsed = records.type_fields(records.parse_responses(asked)).withColumns(
        {
            "stage": F.when(failed, hooks.MODEL).otherwise(F.col("stage")),
            "reason": F.when(failed, "model_failed").otherwise(F.col("reason")),
            "response": F.coalesce("response", "response_error"),
        }
    )
    return _keep_raw(parsed, "response").drop("response", "response_error")
