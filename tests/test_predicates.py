from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postsieve import dims
from postsieve.functions import predicates as p
from postsieve.operators import lookups

NOW = datetime(2024, 1, 31)
SCHEMA = (
    "min_exp string, min_exp_years int, citizenship_required boolean, security_clearance_required boolean, "
    "visa_sponsorship boolean"
)


@pytest.mark.parametrize(
    "raw, years, passes",
    [(None, None, True), ("", None, True), ("N/A", None, True), ("0", 0, True), ("3", 3, True), ("3.9", 3, True),
     ("4", 4, False), ("10", 10, False)],
)
def test_experience_bound(spark, raw, years, passes):
    df = spark.createDataFrame([(raw, years)], "m string, y int")
    assert df.select(p.experience_bound(F.col("m"), F.col("y"), 3)).first()[0] is passes


@pytest.mark.parametrize(
    "flags, kept",
    [((False, False, True), True), ((True, False, True), False), ((False, True, True), False),
     ((False, False, False), False), ((None, False, True), False), ((False, None, True), False),
     ((False, False, None), False)],
)
def test_suitable(spark, flags, kept):
    df = spark.createDataFrame([("N/A", None, *flags)], SCHEMA)
    assert df.filter(p.suitable()).count() == int(kept)


def test_flags_are_compared_not_implied(spark):
    df = spark.createDataFrame([("N/A", None, False, False, True), ("N/A", None, True, False, True)], SCHEMA)
    kept = df.filter(p.suitable(citizenship_required=True)).collect()
    assert [r["citizenship_required"] for r in kept] == [True]


@pytest.mark.parametrize(
    "code, hours, inside",
    [("24H", 24, True), ("24H", 25, False), ("7D", 168, True), ("7D", 169, False), ("1W", 168, True), ("1W", 169, False),
     ("1M", 720, True), ("1M", 721, False), ("24h", 9999, True), ("", 9999, True), ("2W", 9999, True)],
)
def test_timeline(spark, code, hours, inside):
    df = spark.sql(f"SELECT TIMESTAMP_NTZ'2024-01-31' - INTERVAL {hours} HOURS AS ts")
    assert df.filter(p.within_window(F.col("ts"), code, NOW)).count() == int(inside)


def test_window_bound_is_pushed_to_the_scan(spark, capsys):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.filter(p.within_window(F.col("ts"), "7D", NOW)).select("event_id").explain()
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in capsys.readouterr().out


def test_geo_lookup(spark, capsys):
    aliases = [alias for names in dims.GEO_ALIASES.values() for alias in names]
    assert len(aliases) == 20 and len(set(aliases)) == 20
    df = spark.createDataFrame(
        [(x,) for x in ("USA", "America", "INDIA", "de", "Deutschland", "SG", "dubai", "Mars", " us", "", None)], "location string"
    )
    located = lookups.with_geo_id(df)
    got = {r["location"]: r["geo_id"] for r in located.collect()}
    assert got == {
        "USA": "103644278", "America": "103644278", "INDIA": "102713980", "de": "101282230", "Deutschland": "101282230",
        "SG": "102454443", "dubai": "106204383", "Mars": "103644278", " us": "103644278", "": "103644278", None: "103644278",
    }
    assert all(dims.geo_id_of(x) == geo for x, geo in got.items() if x is not None)
    located.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan and "Python" not in plan


def test_timeline_lookup(spark):
    df = spark.createDataFrame([(c,) for c in ("24H", "7D", "1W", "1M", "24h", "")], "code string")
    got = {r["code"]: r["seconds"] for r in lookups.with_timeline_seconds(df).collect()}
    assert got == {"24H": 86400, "7D": 604800, "1W": 604800, "1M": 2592000, "24h": None, "": None}


@pytest.mark.parametrize("query, hit", [("python", True), ("Python  DJANGO", True), ("python rust", False), ("", True)])
def test_keywords(spark, query, hit):
    df = spark.createDataFrame([("Django developer; writes PYTHON",)], "t string")
    assert df.filter(p.matches_keywords(F.col("t"), query)).count() == int(hit)


@pytest.mark.parametrize(
    "low, high, match",
    [(None, None, True), (1, 2, True), (2, 4, True), (2, None, True), (3, None, False), (0, 1, False), (None, 1, True)],
)
def test_age_match(spark, low, high, match):
    df = spark.createDataFrame([(low, high)], "a int, b int")
    assert df.select(p.age_match(F.col("a"), F.col("b"))).first()[0] is match


def test_categories_are_eighteen():
    assert len(dims.CATEGORY_KEYWORDS) == 18


def test_dimension_tables(spark):
    assert dims.geo_alias(spark).count() == 20
    assert dims.timeline(spark).count() == 4
    assert dims.category_keyword(spark).select("category").distinct().count() == 18
    assert [tuple(r) for r in dims.scan_plan(spark).orderBy("scan_rank").collect()] == [
        (0, "recommended", 1), (1, "24H", 2), (2, "7D", 1), (3, "1M", 1),
    ]
