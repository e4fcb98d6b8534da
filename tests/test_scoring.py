import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postsieve.functions import text
from postsieve.operators import records, scoring

TEXTS = [
    "Python and Java, Python again; spark!",
    "nothing in common here",
    "",
    "python java spark and " * 50,
    "SPARK",
    None,
]


def cosine(text, profile):
    a, b = (Counter(re.findall(r"[a-z0-9+#]+", (t or "").lower())) for t in (text, profile))
    norms = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
    return 100 * sum(n * b[t] for t, n in a.items()) / norms if norms else 0.0


@pytest.mark.parametrize("profile", ["python and java, spark spark", "one", "a a a b b and and and java " * 9, "", None])
def test_text_score(spark, profile):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "page_id int, jd string")
    one = spark.createDataFrame([(profile,)], "profile string")
    rows = scoring.with_text_score(df, one).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert row["match_score"] == pytest.approx(cosine(row["jd"], profile), abs=1e-9)
        assert 0 <= row["match_score"] <= 100 + 1e-9


def test_a_large_profile_is_scored_by_the_same_plan(spark):
    profile = " ".join(f"t{i % 5000}" for i in range(7000)) + " python spark"
    texts = [("a", "python t1 t1 t4999 other"), (None, "t3 t3"), (None, "none of them"), ("a", "spark")]
    df = spark.createDataFrame(texts, "page_id string, jd string")
    one = spark.createDataFrame([(profile,)], "profile string")
    got = {r["jd"]: r["match_score"] for r in scoring.with_text_score(df, one).collect()}
    assert got == {jd: pytest.approx(cosine(jd, profile), abs=1e-9) for _, jd in texts}


def test_many_shared_words_in_a_long_text(spark):
    """A text of 100,000 words that shares 5,000 terms with the profile: linear, not words times shared words."""
    rng = random.Random(1)
    profile = " ".join(f"t{rng.randrange(5000)}" for _ in range(20_000))
    long = " ".join(f"t{rng.randrange(6000)}" for _ in range(100_000))
    df = spark.createDataFrame([(i, long if i < 4 else "t1 t2 t1") for i in range(8)], "page_id int, jd string")
    one = spark.createDataFrame([(profile,)], "profile string")
    start = time.perf_counter()
    got = {r["page_id"]: r["match_score"] for r in scoring.with_text_score(df, one).collect()}
    assert time.perf_counter() - start < 20
    assert got == {i: pytest.approx(cosine(long if i < 4 else "t1 t2 t1", profile), abs=1e-9) for i in range(8)}


def test_text_score_moves_no_text(spark, capsys):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumnRenamed("html", "jd")
    profile = spark.sql("SELECT 'some words' AS profile")
    scoring.with_text_score(pages, profile).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "EvalPython" not in plan
    assert plan.count(text.TOKEN) == 1


def test_vector_score(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [-3.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])],
        "id int, embedding array<float>",
    )
    profile = df.filter("id = 0").select("embedding")
    got = {r["id"]: r["match_score"] for r in scoring.with_vector_score(df, profile).collect()}
    assert got == {0: 100.0, 1: 0.0, 2: -100.0, 3: pytest.approx(100 / math.sqrt(2)), 4: None, 5: None, 6: None}


def test_more_than_one_profile_is_an_error(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id int, embedding array<float>")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        scoring.with_vector_score(df, df.select("embedding")).collect()


def test_vector_score_moves_no_vectors(spark, capsys):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    scoring.with_vector_score(vectors, vectors.filter("vec_id = 0").select("embedding")).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize(
    "jd, overall, secondary",
    [
        ("Kubernetes and Docker", "DevOps", "Microservices"),
        ("java Java SPRING, python", "Java", "Python"),
        ("Data\nPipelines; more data, pipelines", "Data Engineering", "SDE"),
        ("full-stack work", "Full Stack", "SDE"),
        ("javascripts and restful, java+", "SDE", "SDE"),
        ("risk management", "Finance", "SDE"),
        ("data", "SDE", "SDE"),
        ("", "SDE", "SDE"),
        (None, "SDE", "SDE"),
    ],
)
def test_classify(spark, jd, overall, secondary):
    row = records.classify(spark.createDataFrame([(jd,)], "jd string")).first()
    assert (row["overall"], row["primary"], row["secondary"]) == (overall, overall, secondary)


def test_rules_stay_on_the_jvm_and_in_the_row(spark, capsys):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", F.col("url").alias("link"), F.col("html").alias("jd"))
    records.extract_fields(pages).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "EvalPython" not in plan
    assert plan.count(text.TOKEN) == 1


@pytest.mark.parametrize(
    "jd, low, high",
    [("Minimum 3 years", "3", "N/A"), ("2-4 years", "2", "4"), ("1 to 2 Years", "1", "2"), ("5+ years", "5", "N/A"), ("1.5 years", "1.5", "N/A"),
     ("1 year", "1", "N/A"), ("3–5 years", "3", "5"), ("2 or more yrs", "2", "N/A"), ("1.5 - 2.5 years", "1.5", "2.5"), ("3 yearsold", "N/A", "N/A"),
     ("no number of years", "N/A", "N/A"), ("in 2019 we; 3 years", "3", "N/A"), ("9" * 20_000, "N/A", "N/A"), (None, "N/A", "N/A")],
)
def test_experience(spark, jd, low, high):
    df = spark.createDataFrame([("http://a.b/c", jd)], "link string, jd string")
    row = records.extract_fields(df).first()
    assert (row["min_exp"], row["max_exp"]) == (low, high)


def test_flags_and_company(spark):
    df = spark.createDataFrame(
        [(0, "https://jobs.acme.org:8080/x?y", "US Citizenship Required. Unable to sponsor."),
         (1, "no url", "Active Security Clearance required"), (2, None, None),
         (3, "https://a.b/", "No security clearance required. U.S. citizenship is required; we cannot sponsor."),
         (4, "https://a.b/", "No US citizenship required, but a security clearance is required.")],
        "id int, link string, jd string",
    )
    rows = records.extract_fields(df).orderBy("id").collect()
    assert [(r["company"], r["citizenship_required"], r["security_clearance_required"], r["visa_sponsorship"]) for r in rows] == [
        ("jobs.acme.org", True, False, False), (None, False, True, True), (None, False, False, True),
        ("a.b", True, False, False), ("a.b", False, True, True),
    ]
