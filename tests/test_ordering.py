import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postsieve.operators import lookups, ordering, scans

NOW = datetime(2024, 1, 31)


def make_events(n, links=7, seed=5, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = NOW - timedelta(minutes=rng.randrange(40 * 24 * 60))
        link = "hot" if rng.random() < hot else f"l{rng.randrange(links)}"
        rows.append((i, ts, link))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, link string").repartition(6)


def newest(rows):
    return sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_first_seen_against_brute_force(spark, hot):
    rows = make_events(600, hot=hot)
    expected = {}
    for row in newest(rows):
        expected.setdefault(row[2], row[0])
    once = ordering.first_seen(frame(spark, rows), "link", ordering.newest_first())
    assert {r["link"]: r["event_id"] for r in once.collect()} == expected
    twice = ordering.first_seen(once, "link", ordering.newest_first())
    assert sorted(twice.collect()) == sorted(once.collect())


def test_first_seen_thins_hot_keys_before_the_shuffle(spark, capsys):
    ordering.first_seen(frame(spark, make_events(50)), "link", ordering.newest_first()).explain()
    plan = capsys.readouterr().out
    assert plan.index("Final") < plan.index("Exchange hashpartitioning(link") < plan.index("Partial")


def test_first_few(spark):
    rows = make_events(300)
    kept = ordering.first_seen(frame(spark, rows), "link", ordering.newest_first(), copies=3).collect()
    expected, seen = set(), {}
    for row in newest(rows):
        seen[row[2]] = seen.get(row[2], 0) + 1
        if seen[row[2]] <= 3:
            expected.add(row[0])
    assert {r["event_id"] for r in kept} == expected


@pytest.mark.parametrize("same_ts", [False, True])
def test_number_pages_against_brute_force(spark, same_ts):
    rows = [(i, NOW if same_ts else ts, link) for i, ts, link in make_events(503)]
    got = ordering.number_pages(frame(spark, rows), ordering.newest_first(), page_size=10)
    expected = {row[0]: divmod(i, 10) for i, row in enumerate(newest(rows))}
    assert {r["event_id"]: (r["page"], r["position"]) for r in got.collect()} == expected


def test_number_pages_per_scan(spark):
    rows = make_events(400)
    listed = scans.union_scans(frame(spark, rows), [("24H", 1), ("7D", 1), ("2W", 1)], NOW)
    got = ordering.number_pages(listed, ordering.newest_first(), scan="scan_rank", page_size=7)
    expected = {}
    for rank, hours in enumerate((24, 168, 10**6)):
        inside = [r for r in newest(rows) if r[1] >= NOW - timedelta(hours=hours)]
        expected |= {(rank, r[0]): divmod(i, 7) for i, r in enumerate(inside)}
    assert {(r["scan_rank"], r["event_id"]): (r["page"], r["position"]) for r in got.collect()} == expected


def test_numbering_never_sorts_a_scan_in_one_task(spark, capsys):
    ordering.number_pages(frame(spark, make_events(50)), ordering.newest_first()).explain()
    plan = capsys.readouterr().out
    # the one window orders partition counts, not rows
    assert plan.count("Window [") == 1 and "sum(_n" in plan


def test_page_limit_is_a_top_k(spark, capsys):
    rows = make_events(200)
    limited = ordering.page_limit(frame(spark, rows), ordering.newest_first(), page_count=2, page_size=10)
    assert [r["event_id"] for r in limited.collect()] == [r[0] for r in newest(rows)[:20]]
    page = ordering.single_page(frame(spark, rows), ordering.newest_first(), page=3, page_size=10)
    assert [r["event_id"] for r in page.collect()] == [r[0] for r in newest(rows)[30:40]]
    limited.explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_union_is_the_sum_of_its_scans(spark):
    rows = make_events(500)
    listed = scans.union_scans(frame(spark, rows), [("24H", 2), ("7D", 1), ("1M", 1), ("none", 1)], NOW)
    got = {r["scan"]: r["n"] for r in listed.groupBy("scan").agg(F.count("*").alias("n")).collect()}
    expected = {
        code: sum(r[1] >= NOW - timedelta(hours=hours) for r in rows)
        for code, hours in (("24H", 24), ("7D", 168), ("1M", 720), ("none", 10**6))
    }
    assert got == expected
    assert got["24H"] <= got["7D"] <= got["1M"] <= got["none"] == 500


def test_union_reads_its_input_once(spark, capsys):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    scans.union_scans(events.select("event_id", "ts"), [("24H", 2), ("7D", 1), ("1M", 1)], NOW).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(ts" in plan and "Exchange" not in plan


def test_top_scans_against_brute_force(spark):
    rows = make_events(700)
    plan = [("24H", 2), ("7D", 1), ("1M", 3)]
    got = scans.top_scans(frame(spark, rows), plan, NOW, page_size=4, first_rank=1)
    expected = set()
    for rank, ((_, pages), hours) in enumerate(zip(plan, (24, 168, 720)), start=1):
        inside = [r for r in newest(rows) if r[1] >= NOW - timedelta(hours=hours)][: pages * 4]
        expected |= {(rank, r[0], *divmod(i, 4)) for i, r in enumerate(inside)}
    assert {(r["scan_rank"], r["event_id"], r["page"], r["position"]) for r in got.collect()} == expected


def test_new_since(spark):
    now = frame(spark, [(1, NOW, "a"), (2, NOW, "b"), (3, NOW, "b"), (4, NOW, "c")])
    before = spark.createDataFrame([("b",), ("b",), (None,)], "link string")
    assert sorted(r["event_id"] for r in lookups.new_since(now, before).collect()) == [1, 4]
    none_before = spark.createDataFrame([], "link string")
    assert lookups.new_since(now, none_before).count() == 4


@pytest.mark.parametrize("page_count,ties", [(3, False), (41, False), (50, False), (50, True), (400, False)])
def test_listed_pages_against_brute_force(spark, page_count, ties):
    rows = make_events(9_000)
    if ties:
        # two thirds of all rows at one time, none at another
        rows = [(i, NOW if i % 3 else None if i % 5 == 0 else ts, link) for i, ts, link in rows]
    df = frame(spark, rows)
    order = [F.col("ts").desc_nulls_last(), F.col("event_id")]
    got = ordering.listed_pages(df, order, F.col("ts"), page_count).collect()
    first = sorted(rows, key=lambda r: (r[1] is None, -(r[1].timestamp() if r[1] else 0), r[0]))[: page_count * 25]
    assert sorted((r["page"], r["position"], r["event_id"]) for r in got) == [(i // 25, i % 25, r[0]) for i, r in enumerate(first)]


def test_a_quantile_thins_long_lists(spark):
    df = frame(spark, make_events(9_000))
    left = ordering._above_quantile(df, F.col("ts"), 300)
    assert 300 <= left.count() <= 1_200
    assert left.agg(F.min("ts")).first()[0] >= df.orderBy(F.col("ts").desc()).limit(1_300).agg(F.min("ts")).first()[0]
    scores = spark.range(9_000).select((F.col("id") / 7.0).alias("match_score"))
    assert 300 <= ordering._above_quantile(scores, F.round("match_score", 2), 300).count() <= 1_200
    equal = spark.range(9_000).select(F.lit(1.5).alias("x"))
    assert ordering._above_quantile(equal, F.col("x"), 300).count() == 9_000
    nothing = equal.filter("x > 2")
    assert ordering._above_quantile(nothing, F.col("x"), 300).count() == 0


def test_many_copies_are_thinned_before_the_shuffle(spark, capsys):
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    try:
        ordering.first_seen(frame(spark, make_events(50)), "link", ordering.newest_first(), copies=1_250).explain()
        plan = capsys.readouterr().out
        assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange hashpartitioning(link") < plan.index("Partial")
    finally:
        spark.conf.set(key, before)
