"""The commands against plain loops over small tables."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsieve import dims, schemas, scratch_path, session
from postsieve.plans import steps
from postsieve.plans.daily import daily
from postsieve.plans.search import recommended, search
from postsieve.sinks import files
from postsieve.sources import fetch
from postsieve.sources.raw_csv import read_digest

NOW = datetime(2024, 1, 31)
PLACES = ["USA", "us", "India", "Germany", "Mars", "SG"]


def make(seed=1, n_pages=40, n_sightings=900, hot=0.4):
    rng = random.Random(seed)
    pages = []
    for i in range(n_pages):
        skill = rng.choice(["Java", "Python", "Spark"])
        # two pages in three share their link with another one after the query is cut
        url = f"http://h{i}.org/{i // 3 if i % 3 else i}?ref={i}"
        html = f"<html><h1>Role {i}, {skill}</h1><article><p>{skill} engineer {i}</p></article></html>"
        pages.append((i, url.replace(f"h{i}", "h"), html, skill))
    sightings = []
    for i in range(n_sightings):
        page = 0 if rng.random() < hot else rng.randrange(n_pages)
        answer = {
            "company": "A, B", "min_exp": rng.choice([1, 2, 3, "N/A", None, "", "2+"]), "max_exp": "N/A",
            "overall": "Java", "primary": "Java", "secondary": "SDE",
            "citizenship_required": rng.choice([False, False, False, True, None]),
            "security_clearance_required": False, "visa_sponsorship": rng.choice([True, True, True, False]),
        }
        text = "```json\n" + json.dumps(answer) + "\n```" if rng.random() > 0.1 else "{oops"
        ts = NOW - timedelta(minutes=rng.randrange(40 * 24 * 60))
        sightings.append((i, ts, page, rng.choice(PLACES), rng.random() < 0.5, text, answer if text[0] == "`" else None))
    scores = [(i, round(rng.uniform(-100, 100), 2)) for i in range(n_pages)]
    return pages, sightings, scores


def frames(spark, pages, sightings, scores):
    return (
        spark.createDataFrame([p[:3] for p in pages], "page_id bigint, url string, html string"),
        spark.createDataFrame(
            [s[:6] for s in sightings],
            "event_id bigint, ts timestamp_ntz, page_id bigint, location string, easy_apply boolean, response string",
        ).repartition(5),
        spark.createDataFrame(scores, "page_id bigint, match_score double"),
    )


def newest(rows):
    return sorted(rows, key=lambda s: (-s[1].timestamp(), s[0]))


def listed(pages, sightings, query, location, timeline, easy_apply, page_count):
    """What one search lists, by a loop."""
    seconds = dims.TIMELINE_SECONDS.get(timeline, 10**9)
    out = []
    for s in newest(sightings):
        title, text = f"Role {s[2]}, {pages[s[2]][3]}", f"{pages[s[2]][3]} engineer {s[2]}"
        if (
            s[1] >= NOW - timedelta(seconds=seconds)
            and dims.geo_id_of(s[3]) == dims.geo_id_of(location)
            and (s[4] or not easy_apply)
            and all(term in f"{title} {text}".lower() for term in query.lower().split())
        ):
            out.append(s)
    return out[: page_count * 25]


def suits(answer, limit):
    low = answer["min_exp"]
    return (
        (low in ("N/A", "", None) or int(low) <= limit)
        and answer["citizenship_required"] is False
        and answer["security_clearance_required"] is False
        and answer["visa_sponsorship"] is True
    )


@pytest.mark.parametrize("query", ["python", "", "engineer java"])
@pytest.mark.parametrize("easy_apply", [False, True])
def test_search(spark, query, easy_apply):
    data = make()
    pages, sightings, scores = frames(spark, *data)
    run = search(pages, sightings, NOW, query, "USA", "1M", easy_apply, page_count=2, scores=scores)
    picked = listed(data[0], data[1], query, "USA", "1M", easy_apply, 2)
    good = [s for s in picked if s[6]]
    expected = sorted((data[0][s[2]][1].split("?")[0], data[2][s[2]][1]) for s in good)
    got = run.records()
    assert got.columns == list(schemas.LAYOUTS["raw_v2"])
    assert sorted((r["link"], r["match_score"]) for r in got.collect()) == expected
    assert run.quarantine().count() == len(picked) - len(good)
    assert run.path == f"jobs_103644278_1M_{easy_apply}_{query}.csv"
    assert run.tagged().select("run_id").distinct().first()[0] == run.run_id


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_daily(spark, hot):
    data = make(seed=3, hot=hot)
    pages, sightings, scores = frames(spark, *data)
    run = daily(
        pages, sightings, NOW, "engineer", "USA", False, 2, "out", scores=scores, day=date(2024, 1, 31)
    ).settled()

    link = {p[0]: p[1].split("?")[0] for p in data[0]}
    score = dict(data[2])
    last = {}
    for s in newest(data[1]):
        last.setdefault(s[2], s)
    best = sorted(link, key=lambda p: (-score[p], link[p], p))[:25]
    scans = [last[p] for p in best if p in last]
    for timeline, count in (("24H", 2), ("7D", 1), ("1M", 1)):
        scans += listed(data[0], data[1], "engineer", "USA", timeline, False, count)

    expected, seen, rejected = [], set(), 0
    for s in scans:
        answer = s[6]
        if answer is None or answer["min_exp"] == "2+":
            rejected += 1
        elif suits(answer, 2) and link[s[2]] not in seen:
            seen.add(link[s[2]])
            low = answer["min_exp"]
            expected.append((link[s[2]], None if low is None else str(low)))

    got = run.digest()
    assert got.columns == list(schemas.LAYOUTS["digest"])
    assert [(r["link"], r["min_exp"]) for r in got.collect()] == expected
    assert len(expected) > 10 or hot
    assert run.quarantine().count() == rejected
    assert run.path == "out/jobs_DAILY_31-01-2024_103644278_False_engineer.csv"

    target = scratch_path(spark, "digest")
    files.write_digest(got, target, single_file=True)
    assert [r["link"] for r in read_digest(spark, target).collect()] == [x for x, _ in expected]


def test_daily_by_rules_and_text(spark):
    data = make(seed=4)
    pages, sightings, _ = frames(spark, *data)
    profile = spark.sql("SELECT 'python engineer' AS profile")
    run = daily(pages, sightings.drop("response"), NOW, "engineer", "India", yoe=2, profile=profile)
    rows = run.digest(with_score=True).collect()
    links = [r["link"] for r in rows]
    assert links and len(links) == len(set(links))
    # the best matches come first
    assert rows[0]["overall"] == "Python" and rows[0]["match_score"] == max(r["match_score"] for r in rows)
    assert run.quarantine().count() == 0


def test_recommended_lists_one_page_of_best_matches(spark):
    data = make(seed=5)
    pages, _, scores = frames(spark, *data)
    rows = recommended(pages, scores=scores, day=date(2024, 1, 9))
    assert rows.path == "jobs_recommended_09-01-2024.csv"
    expected = sorted((s for _, s in data[2]), reverse=True)[:25]
    assert sorted((r["match_score"] for r in rows.records().collect()), reverse=True) == expected


def test_model_answers_in_a_search(spark):
    """The model is called for listed rows only."""
    data = make(seed=6)
    pages, sightings, scores = frames(spark, *data)

    def answer(prompts):
        return ['{"company": "M", "min_exp": 1, "max_exp": 2, "overall": "SDE", "primary": "SDE", "secondary": "SDE", '
                '"citizenship_required": false, "security_clearance_required": false, "visa_sponsorship": true}'
                if "Python" in p.split("Text of the posting:")[1] else "no idea" for p in prompts]

    run = search(
        pages, sightings.drop("response"), NOW, "", "USA", "7D", page_count=1, scores=scores, answer=answer
    ).settled()
    picked = listed(data[0], data[1], "", "USA", "7D", False, 1)
    python = [s for s in picked if data[0][s[2]][3] == "Python"]
    assert run.records().count() == len(python)
    assert {r["reason"] for r in run.quarantine().collect()} == {"model_failed"}
    assert run.quarantine().count() == len(picked) - len(python)


def _formatted(df, capsys):
    """Operators of a plan: name -> the lines said of each."""
    df.explain("formatted")
    parts = capsys.readouterr().out.split("\n\n")
    return [part.strip() for part in parts if part.strip().startswith("(")]


@pytest.fixture
def settled_plans(monkeypatch, capsys):
    """Plans of all intermediates the commands settle."""
    plans = []

    def spied(df, name):
        plans.extend(_formatted(df, capsys))
        return session.settled_table(df, name)

    monkeypatch.setattr(steps, "settled_table", spied)
    return plans


def test_wide_text_is_fetched_for_listed_rows_only(spark, capsys, settled_plans):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    _, sightings, _ = frames(spark, *make())
    scores = pages.select("page_id", F.lit(1.0).alias("match_score"))
    final = _formatted(recommended(pages, scores=scores).records(), capsys)
    # the ranking reads ids and links; html is read once, through a filter by ids that reaches the file
    assert any("TakeOrderedAndProject" in part for part in settled_plans)
    assert not any("html" in part for part in settled_plans)
    wide = [part for part in final if "ReadSchema" in part and "html:string" in part]
    assert len(wide) == 1 and "PushedFilters: [In(page_id, [" in wide[0]
    settled_plans.clear()
    final = _formatted(search(pages, sightings, NOW, "", scores=scores).records(), capsys)
    assert any("WindowGroupLimit" in part and "page_id" in part for part in settled_plans)
    wide = [part for part in final if "ReadSchema" in part and "html:string" in part]
    assert len(wide) == 1 and "PushedFilters: [In(page_id, [" in wide[0]


def test_answers_are_read_where_they_lie(spark, capsys, settled_plans):
    """No answer is in an exchange, a sort or a top-k: they are read by id and parsed at once."""
    data = make(seed=8)
    pages, sightings, scores = frames(spark, *data)
    path = scratch_path(spark, "sightings")
    sightings.write.parquet(path)
    sightings = spark.read.parquet(path)
    run = daily(pages, sightings, NOW, "engineer", "USA", yoe=2, scores=scores)
    final = _formatted(run.rows, capsys)
    moved = [part for part in settled_plans + final if any(
        name in part.split("\n")[0] for name in ("Exchange", "TakeOrdered", "Window", "Sort"))]
    assert moved and not any("response" in part for part in moved)
    assert not any("response" in part for part in settled_plans)
    read = [part for part in final if "ReadSchema" in part and "response:string" in part]
    assert read and all("PushedFilters: [In(event_id, [" in part for part in read)
    # and what the quarantine needs of them is there
    rejected = run.quarantine().collect()
    assert rejected and all(r["raw"] and ("{oops" in r["raw"] or "min_exp" in r["raw"]) for r in rejected)


def test_some_rows_without_an_answer(spark):
    """Rows whose sighting came without an answer get their fields by rule, the others from it."""
    data = make(seed=9)
    pages, sightings, scores = frames(spark, *data)
    some = sightings.withColumn("response", F.when(F.col("event_id") % 2 == 0, F.col("response")))
    rows = search(pages, some, NOW, "", "USA", "1M", page_count=2, scores=scores).rows.collect()
    assert {r["event_id"] % 2 for r in rows} == {0, 1}
    answers = {s[0]: s[6] for s in data[1]}
    for r in rows:
        if r["event_id"] % 2:
            ruled = {"Spark": "Big Data"}.get(data[0][r["page_id"]][3], data[0][r["page_id"]][3])
            assert (r["reason"], r["overall"], r["min_exp"]) == (None, ruled, "N/A")
        elif answers[r["event_id"]] is None:
            assert r["reason"] == "bad_json" and r["raw"] == "{oops"
        else:
            assert (r["reason"], r["overall"]) == (None, "Java")


def test_more_pages_than_a_filter_lists(spark, monkeypatch):
    """The same run with ids as a filter and with a join on them."""
    data = make(seed=10)
    pages, sightings, scores = frames(spark, *data)

    def links():
        run = search(pages, sightings, NOW, "", "USA", "1M", page_count=3, scores=scores)
        return sorted((r["link"], r["match_score"], r["min_exp"] or "") for r in run.records().collect())

    listed_ids = links()
    monkeypatch.setattr(steps, "LISTED_IDS", 10)
    monkeypatch.setattr(steps, "by_ids", lambda table, ids, key: fetch.by_ids(table, ids, key, listed=10))
    assert links() == listed_ids and listed_ids


def test_fifty_pages(spark, settled_plans):
    """A long search against a loop: no task gets every other task's list, and hot pages are thinned all the same."""
    data = make(seed=11, n_sightings=8_000, hot=0.6)
    pages, sightings, scores = frames(spark, *data)
    run = search(pages, sightings.drop("response"), NOW, "", "USA", "1M", page_count=50, scores=scores)
    got = [(r["page"], r["position"], r["event_id"]) for r in run.rows.collect()]
    picked = listed(data[0], data[1], "", "USA", "1M", False, 50)
    assert len(picked) == 1250
    assert sorted(got) == [(i // 25, i % 25, s[0]) for i, s in enumerate(picked)]
    assert not any("TakeOrdered" in part for part in settled_plans)
    # what comes together are counts, one per range
    together = [part for part in settled_plans if "SinglePartition" in part]
    assert all("_part#" in part and "event_id" not in part for part in together)
