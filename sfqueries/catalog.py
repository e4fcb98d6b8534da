"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve import dims, schemas
from postsieve.functions import extract, predicates, text
from postsieve.functions.response import strip_fence
from postsieve.operators import hooks, lookups, ordering, records, scans, scoring
from postsieve.operators.filters import keyword_filter
from postsieve.operators.vector_store import Encoder, encoded_scores
from postsieve.plans.daily import daily
from postsieve.plans.merge import merge
from postsieve.plans.search import recommended, search
from postsieve.session import scratch_path, settled_table
from postsieve.sinks import files
from postsieve.sinks.pages import write_pages
from postsieve.sources.pages import posting_headings, posting_texts, scan_postings
from postsieve.sources.profile import read_profile
from postsieve.sources.raw_csv import read_digest, read_raw_postings
from postsieve.sources.term_index import index_terms, only_files_with
from postsieve.streaming import digest as stream

from . import fixtures as fx

SEARCHES = (("24H", 2), ("7D", 1), ("1M", 1))
SCORE_DIGITS = 4


def _score() -> F.Column:
    return F.round("match_score", SCORE_DIGITS).alias("match_score")


def _texts(spark, sf):
    return posting_texts(fx.postings_html(spark, sf))


def _typed(spark, sf):
    """Answers of all sightings, parsed, typed and checked; no page columns yet."""
    answers = fx.answered(fx.sightings(spark, sf, spread=True)).select("event_id", "ts", "page_id", "response")
    return records.check_experience(records.type_fields(records.parse_responses(answers)))


def _usable(spark, sf):
    return _typed(spark, sf).filter("reason IS NULL")


def _headings(spark, sf):
    """(page_id, link as found, title): what records need of a page."""
    return scan_postings(fx.pages(spark, sf, spread=True)).select("page_id", "link", "title")


def _stored_scores(spark, sf):
    return settled_table(_scores(spark, sf), "scores")


def _scores(spark, sf):
    vectors = fx.page_vectors(spark, sf)
    return scoring.with_vector_score(vectors, fx.profile_vector(spark, sf)).select("page_id", _score())


# --- scans and text ----------------------------------------------------------------------------

def q_scan_postings(spark, sf):
    return scan_postings(fx.pages(spark, sf, spread=True))


def q_normalize_link(spark, sf):
    return fx.pages(spark, sf).select("page_id", text.normalize_link(F.col("url")).alias("link"))


def q_strip_commas(spark, sf):
    return scan_postings(fx.pages(spark, sf, spread=True)).select("page_id", text.strip_commas(F.col("title")).alias("title"))


def q_html_to_text(spark, sf):
    return fx.pages(spark, sf, spread=True).select(
        "page_id", text.html_to_text(text.article_html(F.col("html"))).alias("jd")
    )


def q_date_stamp(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", text.date_stamp(F.col("ts")).alias("stamp"))


# --- answers -----------------------------------------------------------------------------------

def q_strip_fence(spark, sf):
    return fx.answered(fx.table(spark, sf, "events", spread=True)).select("event_id", strip_fence(F.col("response")).alias("body"))


def q_parse_response(spark, sf):
    answers = fx.answered(fx.table(spark, sf, "events", spread=True)).select("event_id", "response")
    return records.parse_responses(answers).drop("response")


def q_typed_fields(spark, sf):
    return _usable(spark, sf).select("event_id", "min_exp_years", "max_exp_years", *schemas.FLAGS)


def _raw_rows(spark, sf):
    """Usable answers with link, title and score of their page.

    What pages contribute is settled as a narrow table first: the join then has a plain table on
    one side, which Spark may broadcast if it turns out small, or else split where a page holds
    too many sightings.
    """
    page_rows = settled_table(_headings(spark, sf).join(_scores(spark, sf), "page_id"), "page_rows")
    return _usable(spark, sf).join(page_rows, "page_id")


def q_raw_record(spark, sf):
    return records.raw_record(_raw_rows(spark, sf), "raw_v2")


def q_raw_record_v1(spark, sf):
    rows = records.with_age_match(_usable(spark, sf)).join(_headings(spark, sf), "page_id")
    return records.raw_record(rows, "raw_v1")


def q_quarantine(spark, sf):
    rows = _typed(spark, sf).join(_headings(spark, sf).drop("title"), "page_id")
    return records.split_quarantine(rows)[1]


def q_digest_projection(spark, sf):
    kept = _usable(spark, sf).filter(predicates.suitable(dims.DEFAULT_YEARS))
    return records.digest(kept.join(_headings(spark, sf), "page_id"))


# --- filters and lookups -----------------------------------------------------------------------

def q_time_window(spark, sf):
    events = fx.table(spark, sf, "events")
    inside = predicates.within_window(F.col("ts"), "7D", fx.as_of(spark, sf))
    return events.filter(inside).select("event_id", "ts")


def q_time_window_past(spark, sf):
    """A window that ends in the past: nothing after it is listed."""
    inside = predicates.within_window(F.col("ts"), "7D", datetime(2024, 1, 15, 12))
    return fx.table(spark, sf, "events").filter(inside).select("event_id", "ts")


def q_geo_filter(spark, sf):
    located = lookups.with_geo_id(fx.sightings(spark, sf).select("event_id", "location"))
    return located.filter(F.col("geo_id") == dims.geo_id_of("India"))


def q_keyword_filter(spark, sf):
    return keyword_filter(_texts(spark, sf), "Python django").select("page_id", "title")


def q_keyword_filter_indexed(spark, sf):
    """A page table written in order of its ids, searched with sketches of its files' terms."""
    path, index = scratch_path(spark, "pages"), scratch_path(spark, "terms")
    write_pages(fx.postings_html(spark, sf), path)
    pages = spark.read.parquet(path)
    index_terms(pages, index)
    searched = only_files_with(pages, "Python django", index)
    return keyword_filter(posting_texts(searched), "Python django").select("page_id", "title")


def q_easy_apply_filter(spark, sf):
    return fx.sightings(spark, sf).filter("easy_apply").select("event_id")


def q_suitability(spark, sf):
    return _usable(spark, sf).filter(predicates.suitable(dims.DEFAULT_YEARS)).select("event_id", "min_exp")


def q_experience_bound(spark, sf):
    bound = predicates.experience_bound(F.col("min_exp"), F.col("min_exp_years"), dims.DEFAULT_YEARS)
    return _usable(spark, sf).select("event_id", bound.alias("within_bound"))


def q_age_match(spark, sf):
    ruled = records.type_fields(records.extract_fields(_texts(spark, sf)))
    return records.with_age_match(ruled).select("page_id", "age_match")


def q_geo_lookup(spark, sf):
    return lookups.with_geo_id(fx.sightings(spark, sf).select("event_id", "location"))


def q_timeline_lookup(spark, sf):
    coded = fx.table(spark, sf, "events").select("event_id", F.expr(fx.TIMELINE_SQL).alias("code"))
    return lookups.with_timeline_seconds(coded)


def q_new_since_last(spark, sf):
    """Suitable links of the last week that were not among those of the first day."""
    as_of = fx.as_of(spark, sf)
    suitable = _usable(spark, sf).filter(predicates.suitable(dims.DEFAULT_YEARS)).select("event_id", "ts", "page_id")
    first_day = fx.table(spark, sf, "events").select(F.min("ts") + F.make_dt_interval(days=F.lit(1))).scalar()
    links = fx.pages(spark, sf).select("page_id", text.normalize_link(F.col("url")).alias("link"))

    def seen(rows):
        # one row per page before links are looked up, then one per link
        by_page = ordering.first_seen(rows, "page_id", ordering.newest_first())
        return ordering.first_seen(by_page.join(links, "page_id"), "link", ordering.newest_first())

    now = seen(suitable.filter(predicates.within_window(F.col("ts"), "7D", as_of)))
    before = seen(suitable.filter(F.col("ts") < first_day))
    return lookups.new_since(now, before).select("link", "event_id")


# --- scans, order, distinct --------------------------------------------------------------------

def q_union_scans(spark, sf):
    narrow = fx.sightings(spark, sf).select("event_id", "ts", "page_id")
    return scans.union_scans(narrow, SEARCHES, fx.as_of(spark, sf))


def q_top_scans(spark, sf):
    narrow = fx.sightings(spark, sf).select("event_id", "ts", "page_id")
    return scans.top_scans(narrow, SEARCHES, fx.as_of(spark, sf))


def q_first_seen_dedupe(spark, sf):
    """Three overlapping scans, suitable answers only, the first copy of every link."""
    # an answer is read once, however many scans list its sighting
    kept = _usable(spark, sf).filter(predicates.suitable(dims.DEFAULT_YEARS)).select(
        "event_id", "ts", "page_id", "min_exp"
    )
    listed = scans.union_scans(kept, SEARCHES, fx.as_of(spark, sf))
    # copies collapse per page before the page table is joined, then per link
    by_page = ordering.first_seen(listed, "page_id")
    links = fx.pages(spark, sf).select("page_id", text.normalize_link(F.col("url")).alias("link"))
    return ordering.first_seen(by_page.join(links, "page_id"), "link").select(
        "link", "event_id", "ts", "scan_rank", "min_exp"
    )


def q_page_position(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id", "ts")
    return ordering.number_pages(events, ordering.newest_first())


def q_scan_position(spark, sf):
    listed = scans.union_scans(fx.table(spark, sf, "events").select("event_id", "ts"), SEARCHES, fx.as_of(spark, sf))
    return ordering.number_pages(listed, ordering.newest_first(), scan="scan_rank").drop("scan")


def q_page_limit(spark, sf):
    narrow = fx.sightings(spark, sf).select("event_id", "ts", "page_id")
    return ordering.page_limit(narrow, ordering.newest_first(), page_count=2)


def q_long_list(spark, sf):
    """Fifty pages of a scan, numbered by range."""
    narrow = fx.sightings(spark, sf).select("event_id", "ts", "page_id")
    return ordering.listed_pages(narrow, ordering.newest_first(), F.col("ts"), page_count=50)


def q_single_page(spark, sf):
    narrow = fx.sightings(spark, sf).select("event_id", "ts", "page_id")
    return ordering.single_page(narrow, ordering.newest_first(), page=1)


# --- extraction and scores ---------------------------------------------------------------------

def q_extract_company(spark, sf):
    return fx.pages(spark, sf).select("page_id", extract.company(F.col("url")).alias("company"))


def q_extract_experience(spark, sf):
    jd = F.col("jd")
    return _texts(spark, sf).select(
        "page_id", extract.min_experience(jd).alias("min_exp"), extract.max_experience(jd).alias("max_exp")
    )


def q_extract_flags(spark, sf):
    jd = F.col("jd")
    return _texts(spark, sf).select(
        "page_id",
        extract.citizenship_required(jd).alias("citizenship_required"),
        extract.security_clearance_required(jd).alias("security_clearance_required"),
        extract.visa_sponsorship(jd).alias("visa_sponsorship"),
    )


def q_classify(spark, sf):
    return records.classify(_texts(spark, sf)).select("page_id", "overall", "primary", "secondary")


def q_match_score_vector(spark, sf):
    scored = scoring.with_vector_score(fx.vectors(spark, sf), fx.profile_vector(spark, sf))
    return scored.select("vec_id", _score())


def q_match_score_text(spark, sf):
    return scoring.with_text_score(_texts(spark, sf), fx.profile_text(spark)).select("page_id", _score())


# --- files -------------------------------------------------------------------------------------

def q_read_raw_postings(spark, sf):
    path = scratch_path(spark, "raw_v2")
    files.append_raw(q_raw_record(spark, sf), path)
    return read_raw_postings(spark, path)


def q_append_roundtrip(spark, sf):
    """The same run appended twice to one folder, read back: every row is there twice."""
    path = scratch_path(spark, "raw_v2")
    rows = records.raw_record(_raw_rows(spark, sf))
    files.append_raw(rows, path)
    files.append_raw(rows, path)
    return read_raw_postings(spark, path).drop(schemas.CORRUPT)


def q_digest_roundtrip(spark, sf):
    targets = [scratch_path(spark, "digest"), scratch_path(spark, "copy")]
    files.write_digest(q_digest_projection(spark, sf), targets)
    return read_digest(spark, targets[1])


def q_merge_raw(spark, sf):
    """Three header-less files, one per timeline, put together with repeats."""
    as_of = fx.as_of(spark, sf)
    rows = records.with_age_match(_usable(spark, sf)).join(_headings(spark, sf), "page_id")
    paths = []
    for timeline, _ in SEARCHES:
        path = scratch_path(spark, f"jobs_{timeline}")
        inside = predicates.within_window(F.col("ts"), timeline, as_of)
        files.append_raw(records.raw_record(rows.filter(inside), "raw_v1"), path, "raw_v1")
        paths.append(path)
    return merge(spark, paths)[0]


# --- commands ----------------------------------------------------------------------------------

def q_search(spark, sf):
    """Rules for the fields, text for the score."""
    run = search(
        fx.postings_html(spark, sf), fx.sightings(spark, sf), fx.as_of(spark, sf),
        query="experience", location="USA", timeline="1M", easy_apply=True, page_count=2,
        profile=fx.profile_text(spark),
    )
    return run.records().withColumn("match_score", _score())


def q_search_written(spark, sf):
    """The same search written below a folder and read back."""
    run = search(
        fx.postings_html(spark, sf), fx.sightings(spark, sf), fx.as_of(spark, sf),
        query="experience", location="USA", timeline="1M", easy_apply=True, page_count=2,
        profile=fx.profile_text(spark),
    )
    written = read_raw_postings(spark, run.write(scratch_path(spark, "runs")))
    return written.drop(schemas.CORRUPT).withColumn("match_score", _score())


def q_run_envelope(spark, sf):
    """Rows of a run with its id and the name of its file."""
    run = daily(
        fx.postings_html(spark, sf), fx.sightings(spark, sf), fx.as_of(spark, sf),
        query="spark", location="USA", yoe=2, save="out", profile=fx.profile_text(spark),
    )
    tagged = run.tagged().filter(F.col("reason").isNull())
    return tagged.select("link", F.lit(run.path).alias("path"), F.length("run_id").alias("id_length"))


def q_read_profile(spark, sf):
    """All pages scored against a profile that was written as a file and read back."""
    path = scratch_path(spark, "profile")
    fx.profile_text(spark).select(F.col("profile").alias("value")).coalesce(1).write.text(path)
    profile = read_profile(spark, path)
    return scoring.with_text_score(_texts(spark, sf), profile).select("page_id", _score())


def q_search_answers(spark, sf):
    """Fields from answers, stored scores."""
    run = search(
        fx.pages(spark, sf, spread=True), fx.answered(fx.sightings(spark, sf)), fx.as_of(spark, sf),
        query="", location="Germany", timeline="7D", page_count=3, scores=_stored_scores(spark, sf),
    )
    return run.records()


def q_recommended(spark, sf):
    run = recommended(fx.postings_html(spark, sf), scores=_stored_scores(spark, sf))
    return run.records()


def q_recommended_text(spark, sf):
    run = recommended(fx.postings_html(spark, sf), profile=fx.profile_text(spark))
    return run.records().withColumn("match_score", _score())


def q_daily_digest(spark, sf):
    """Fields from answers, stored scores."""
    run = daily(
        fx.postings_html(spark, sf), fx.answered(fx.sightings(spark, sf)), fx.as_of(spark, sf),
        query="experience", location="USA", yoe=2, scores=_stored_scores(spark, sf),
    )
    return run.digest(with_score=True)


def q_daily_digest_text(spark, sf):
    """Rules for the fields, text for the score."""
    run = daily(
        fx.postings_html(spark, sf), fx.sightings(spark, sf), fx.as_of(spark, sf),
        query="spark", location="USA", yoe=2, profile=fx.profile_text(spark),
    )
    return run.digest(with_score=True).withColumn("match_score", _score())


def _encoder(spark) -> Encoder:
    """A toy encoder (length and letter counts) with a store of its own."""
    return Encoder(_letter_counts, scratch_path(spark, "vectors"), "letters")


def q_match_score_encoded(spark, sf):
    """All pages scored by encoder twice; the second time from the stored vectors alone."""
    pages, encoder = fx.postings_html(spark, sf), _encoder(spark)
    encoded_scores(pages, fx.profile_text(spark), encoder)
    again = Encoder(_no_encoding, encoder.store, encoder.name)
    return encoded_scores(pages, fx.profile_text(spark), again).select("page_id", _score())


def q_search_encoded(spark, sf):
    """Rules for the fields, an encoder for the score of the listed pages."""
    run = search(
        fx.postings_html(spark, sf), fx.sightings(spark, sf), fx.as_of(spark, sf),
        query="experience", location="USA", timeline="1M", easy_apply=True, page_count=2,
        profile=fx.profile_text(spark), encoder=_encoder(spark),
    )
    return run.records().withColumn("match_score", _score())


def q_recommended_encoded(spark, sf):
    run = recommended(fx.postings_html(spark, sf), profile=fx.profile_text(spark), encoder=_encoder(spark))
    return run.records().withColumn("match_score", _score())


def q_daily_digest_encoded(spark, sf):
    """Fields from answers, scores from an encoder whose vectors an earlier run has stored."""
    pages, encoder = fx.postings_html(spark, sf), _encoder(spark)
    encoded_scores(pages, fx.profile_text(spark), encoder)
    run = daily(
        pages, fx.answered(fx.sightings(spark, sf)), fx.as_of(spark, sf), query="experience", location="USA", yoe=2,
        profile=fx.profile_text(spark), encoder=Encoder(_no_encoding, encoder.store, encoder.name),
    )
    return run.digest(with_score=True).withColumn("match_score", _score())


# --- hooks and stream --------------------------------------------------------------------------

def q_model_hook(spark, sf):
    """A toy model that answers by text length and refuses some lengths."""
    def answer(prompts):
        answers = []
        for prompt in prompts:
            n = len(prompt.split("Text of the posting:\n", 1)[1])
            if n % 10 == 0:
                raise RuntimeError("no answer")
            answers.append(
                '```json\n{"company": "n%d", "min_exp": %d, "max_exp": "N/A", "overall": "SDE", "primary": "SDE", '
                '"secondary": "SDE", "citizenship_required": false, "security_clearance_required": false, '
                '"visa_sponsorship": true}\n```' % (n, n % 7)
            )
        return answers

    asked = hooks.with_responses(_texts(spark, sf).select("page_id", "link", "jd"), answer, max_attempts=3, first_wait=0)
    return records.parse_responses(asked).select("page_id", "company", "min_exp", "reason")


def _letter_counts():
    import numpy as np

    def predict(texts):
        return np.array([[len(t), t.count("a"), t.count("e")] for t in texts], dtype="float32")

    return predict


def _no_encoding():
    raise RuntimeError("nothing is left to encode")


def q_encode_hook(spark, sf):
    """A toy encoder: length and letter counts."""
    encode = hooks.encoder(_letter_counts)
    encoded = _texts(spark, sf).select("page_id", encode(F.col("jd")).alias("vector"))
    return encoded.select("page_id", *(F.get("vector", F.lit(i)).cast("bigint").alias(f"v{i}") for i in range(3)))


def _run_stream(spark, sf):
    """The folders of a digest and its quarantine after all events have streamed in."""
    events = fx.table(spark, sf, "events")
    arriving = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .select("event_id", "ts")
    )
    count = fx.row_count(spark, sf, "pages")
    sighted = fx.answered(arriving.withColumn("page_id", F.col("event_id") % count))
    pages = settled_table(posting_headings(fx.pages(spark, sf)), "headings")
    out, bad, checkpoint = (scratch_path(spark, name) for name in ("digest", "quarantine", "state"))
    stream.append_digest(sighted, pages, out, bad, checkpoint, yoe=2).awaitTermination()
    return out, bad


def q_stream_digest(spark, sf):
    out, _ = _run_stream(spark, sf)
    return spark.read.parquet(out).select(*schemas.LAYOUTS["digest"])


def q_stream_quarantine(spark, sf):
    _, bad = _run_stream(spark, sf)
    return spark.read.schema("link string, stage string, reason string, raw string").json(bad).drop("batch_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name[2:]: function for name, function in globals().items() if name.startswith("q_")}
