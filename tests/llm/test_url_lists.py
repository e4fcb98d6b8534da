from datetime import date

import __spark_entry__ as entry
from postsieve.llm import url_lists
from tests.compare import duck, duck_rows, spark_rows


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        df = entry.queries()["op8_url_lists"](spark, sf)
        assert spark_rows(df) == duck_rows(duck(sf), entry.oracle_sql()["op8_url_lists"])


def day(n):
    return date(2024, 1, 1 + n)


def test_entries_hold_from_their_date_to_the_next(spark):
    entries = spark.createDataFrame(
        [("Bad.com", day(5), "block"), ("bad.com", day(10), "allow"), ("x.bad.com/a", day(12), "block"), ("com", day(3), "allow"),
         (None, day(1), "block"), ("bad.com", None, "block"), ("bad.com", day(10), "aaa")],
        "rule string, since date, action string",
    )
    captures = spark.createDataFrame(
        [(1, "http://bad.com/", day(4)), (2, "http://X.bad.com:80/a/b?q", day(5)), (3, "https://u:p@bad.com", day(9)), (4, "http://bad.com", day(10)),
         (5, "http://x.bad.com/a/b", day(12)), (6, "http://x.bad.com/ab", day(12)), (7, "http://notbad.com", day(6)), (8, None, day(6)),
         (9, "not a url", day(6)), (10, "http://bad.com", None), (11, "http://bad.com", day(6)), (11, "http://bad.com", day(6)), (None, "", day(6))],
        "id long, url string, fetched date",
    ).selectExpr("*", "1 AS rule", "'x' AS action", "2 AS _row")
    got = sorted(
        ((r["id"] or 0, r["rule"], r["blocked"]) for r in url_lists.judge(captures, entries, keep=["id"]).collect()), key=str
    )
    assert got == sorted([
        (1, "com", False), (2, "bad.com", True), (3, "bad.com", True), (4, "bad.com", False), (5, "x.bad.com/a", True), (6, "bad.com", False),
        (7, "com", False), (8, None, False), (9, None, False), (10, None, False), (11, "bad.com", True), (11, "bad.com", True), (0, None, False),
    ], key=str)


def test_paths_keep_their_case(spark):
    entries = spark.createDataFrame([("Example.com/Ads", day(1), "block"), ("Plain.COM", day(1), "block")], "rule string, since date, action string")
    captures = spark.createDataFrame(
        [(1, "http://EXAMPLE.com/Ads/x", day(2)), (2, "http://example.com/ads/x", day(2)), (3, "http://plain.com/Ads", day(2))],
        "id long, url string, fetched date",
    )
    got = {r["id"]: (r["rule"], r["blocked"]) for r in url_lists.judge(captures, entries, keep=["id"]).collect()}
    assert got == {1: ("example.com/Ads", True), 2: (None, False), 3: ("plain.com", True)}


def test_wild_dates_and_very_long_addresses(spark):
    entries = spark.createDataFrame(
        [("com", day(3), "block"), ("com", day(28), "allow"), ("org/a/b", day(1), "block"), ("x.net", date(1, 1, 1), "block"), ("y.net", date(9999, 12, 31), "block")]
        + [(f"h{i}.org", day(i % 20), "block") for i in range(300)],
        "rule string, since date, action string",
    )
    deep = "/".join("ab" * 4_000)
    captures = spark.createDataFrame(
        [(1, "http://q.com", date(9999, 12, 31)), (2, "http://q.com", day(5)), (3, f"http://org/{deep}", day(5)), (4, f"http://org/b/{deep}", day(5)),
         (5, "http://x.net", date(1, 1, 1)), (6, "http://x.net", day(9)), (7, "http://y.net", day(9)), (8, "http://y.net", date(9999, 12, 31)),
         (9, "http://h7.org", date(9999, 12, 31)), (10, "http://h7.org", day(6)), (11, "http://h7.org", day(7)), (12, "http://q.com", date(1, 1, 1))],
        "id long, url string, fetched date",
    )
    got = {r["id"]: (r["rule"], r["blocked"]) for r in url_lists.judge(captures, entries, keep=["id"]).collect()}
    assert got == {
        1: ("com", False), 2: ("com", True), 3: ("org/a/b", True), 4: (None, False), 5: ("x.net", True), 6: ("x.net", True), 7: (None, False),
        8: ("y.net", True), 9: ("h7.org", True), 10: (None, False), 11: ("h7.org", True), 12: (None, False),
    }


def test_empty_lists_and_tables(spark):
    entries = spark.createDataFrame([], "rule string, since date, action string")
    captures = spark.createDataFrame([(1, "http://a.b", day(1))], "id long, url string, fetched date")
    assert [tuple(r) for r in url_lists.judge(captures, entries, keep=["id"]).collect()] == [(1, None, None, None, False)]
    assert url_lists.judge(captures.limit(0), entries, keep=["id"]).count() == 0
