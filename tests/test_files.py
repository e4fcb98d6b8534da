from datetime import date

import pytest
from pyspark.sql import functions as F

from postsieve import schemas, scratch_path
from postsieve.operators import records
from postsieve.plans.merge import merge
from postsieve.sinks import files, names
from postsieve.sources.profile import read_profile
from postsieve.sources.raw_csv import misfits, read_digest, read_raw_postings

ROWS = [
    ("plain title", "Acme Inc", "2", "N/A", "Java", "Java", "SDE", False, False, True, 12.5, "http://a/1"),
    ('say "hi", twice', "B", None, "N/A", "Java, mostly", "Java", "SDE", True, False, False, -3.25, "http://a/2"),
    ("", None, "N/A", "N/A", "SDE", "SDE", "SDE", None, None, None, None, "http://a/3"),
]


def records_v2(spark):
    return spark.createDataFrame(ROWS, schemas.layout("raw_v2"))


def test_append_and_read_back(spark):
    path = scratch_path(spark, "raw")
    files.append_raw(records_v2(spark), path)
    files.append_raw(records_v2(spark), path)
    rows = read_raw_postings(spark, path)
    assert rows.filter(misfits()).count() == 0
    got = sorted(map(tuple, rows.drop(schemas.CORRUPT).collect()), key=lambda r: r[-1])
    expected = sorted([(None if r[0] == "" else r[0], *r[1:]) for r in ROWS * 2], key=lambda r: r[-1])
    assert got == expected
    assert any("True" in line[0] for line in spark.read.text(path).collect())


def test_misfit_lines_are_marked_and_go_to_quarantine(spark):
    path = scratch_path(spark, "bad")
    lines = [
        "t,c,1,N/A,True,Java,Java,SDE,False,False,True,http://a/1",
        "t,c,1,N/A,True,Java, mostly,Java,SDE,False,False,True,http://a/2",
        "t,c,,,true,Java,Java,SDE,false,false,true,http://a/3",
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    targets = [scratch_path(spark, "digest"), scratch_path(spark, "copy")]
    merged, bad = merge(spark, [path, path], targets)
    assert merged.count() == 4 and bad.count() == 2
    assert {r["reason"] for r in bad.collect()} == {"bad_row"}
    for target in targets:
        assert sorted(map(str, read_digest(spark, target).collect())) == sorted(map(str, merged.collect()))
    header = {spark.read.text(targets[0]).first()[0]}
    assert header == {",".join(schemas.LAYOUTS["digest"])}


def test_misfits_do_not_depend_on_the_columns_asked_for(spark):
    path = scratch_path(spark, "wide")
    line = "t,c,1,N/A,Java,Java,SDE,False,False,True,1.5,http://a/1,one,too many"
    spark.createDataFrame([(line,)], "value string").write.text(path)
    rows = read_raw_postings(spark, path)
    assert rows.select("title", schemas.CORRUPT).first()[1] == line
    assert rows.filter(misfits()).select("title").count() == 1


def test_layouts_differ_though_both_have_twelve_columns():
    assert len(schemas.LAYOUTS["raw_v1"]) == len(schemas.LAYOUTS["raw_v2"]) == len(schemas.LAYOUTS["digest"]) == 12
    assert schemas.LAYOUTS["raw_v1"] != schemas.LAYOUTS["raw_v2"]


def test_digest_projection(spark):
    plain = records.digest(records_v2(spark))
    assert plain.columns == list(schemas.LAYOUTS["digest"])
    assert plain.filter("age_match IS NOT NULL").count() == 0
    scored = records.digest(records_v2(spark), with_score=True)
    assert sorted(r["match_score"] for r in scored.collect() if r["match_score"]) == [-3.25, 12.5]


def test_raw_record_cleans_title_company_and_link(spark):
    df = records_v2(spark).withColumns({"company": F.lit("A, B"), "title": F.lit("x, y"), "link": F.lit("l?q")})
    df = df.withColumn("age_match", F.lit(True))
    new = records.raw_record(df, "raw_v2").first()
    assert (new["title"], new["company"], new["link"]) == ("x y", "A B", "l")
    assert records.raw_record(df, "raw_v1").first()["link"] == "l?q"


def test_split_write(spark):
    df = records_v2(spark).withColumns(
        {"stage": F.lit("parse"), "reason": F.when(F.col("link").endswith("2"), "bad_json"), "raw": F.lit("x\ny,z")}
    )
    good, bad = scratch_path(spark, "good"), scratch_path(spark, "quarantine")
    files.write_split(df, good, bad)
    assert read_raw_postings(spark, good).count() == 2
    assert [tuple(r) for r in spark.read.json(bad).select(*schemas.QUARANTINE).collect()] == [
        ("http://a/2", "parse", "bad_json", "x\ny,z")
    ]
    links = scratch_path(spark, "errors")
    files.append_error_links(df.filter("reason IS NOT NULL"), links)
    assert [r[0] for r in spark.read.text(links).collect()] == ["http://a/2"]


def test_partitioned_append(spark):
    path = scratch_path(spark, "parts")
    df = records_v2(spark).withColumns({"geo_id": F.lit("1"), "timeline": F.lit("24H"), "easy_apply": F.lit(False)})
    files.append_raw(df, path, partition_by=["geo_id", "timeline", "easy_apply"])
    assert read_raw_postings(spark, f"{path}/geo_id=1/timeline=24H/easy_apply=false").count() == 3


@pytest.mark.parametrize("content", ["my profile\nwith lines\n", ""])
def test_profile(spark, tmp_path, content):
    path = tmp_path / "profile.txt"
    path.write_text(content)
    rows = read_profile(spark, str(path)).collect()
    assert [r["profile"] for r in rows] == [content]


def test_several_profiles_are_an_error(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(name)
    with pytest.raises(Exception, match="more than one file"):
        read_profile(spark, str(tmp_path)).collect()


def test_missing_profile_is_empty(spark, tmp_path):
    assert [r["profile"] for r in read_profile(spark, str(tmp_path / "none.txt")).collect()] == [""]


def test_names():
    day = date(2024, 1, 9)
    assert names.search_name("Software Engineer", "India", "24H", False) == "jobs_102713980_24H_False_Software Engineer.csv"
    assert names.search_name("x", "nowhere", "7D", True, "_tmp") == "jobs_103644278_7D_True_x_tmp.csv"
    assert names.recommended_name(day) == "jobs_recommended_09-01-2024.csv"
    assert names.daily_name("x", "de", False, day) == "jobs_DAILY_09-01-2024_101282230_False_x.csv"
    assert names.below("out/", "a.csv") == "out/a.csv"
