import json

import pytest
from pyspark.sql import functions as F

from postsieve.functions import response
from postsieve.operators import records

BASE = {
    "company": "Acme, Inc", "min_exp": 1, "max_exp": "N/A", "overall": "Java", "primary": "Java", "secondary": "SDE",
    "citizenship_required": False, "security_clearance_required": False, "visa_sponsorship": True,
}


def answers(spark, *texts):
    return spark.createDataFrame([(i, f"l{i}", t) for i, t in enumerate(texts)], "id int, link string, response string")


def fenced(changes=(), drop=(), tail=""):
    body = {k: v for k, v in {**BASE, **dict(changes)}.items() if k not in drop}
    return "```json\n" + json.dumps(body) + "\n```" + tail


def checked(spark, *texts):
    return records.check_experience(records.type_fields(records.parse_responses(answers(spark, *texts)))).orderBy("id")


@pytest.mark.parametrize(
    "wrap", ["```json\n{}\n```", "```json\n{}\n```\n", "{}", "Here you are: {} Bye."]
)
def test_fence_forms_give_the_object(spark, wrap):
    body = json.dumps(BASE)
    got = answers(spark, wrap.replace("{}", body)).select(response.strip_fence(F.col("response"))).first()[0]
    assert got == body


def test_text_without_braces_gives_nothing(spark):
    assert answers(spark, "no object").select(response.strip_fence(F.col("response"))).first()[0] == ""


def test_reasons(spark):
    rows = checked(
        spark,
        fenced(),
        "```json\n{broken\n```",
        "[1, 2]",
        None,
        fenced(drop=["visa_sponsorship"]),
        fenced({"company": None}),
        fenced({"min_exp": "2+"}),
        fenced({"min_exp": None}),
        fenced({"min_exp": "N/A"}),
        fenced({"min_exp": ""}),
        fenced({"min_exp": "n/a"}),
        fenced({"min_exp": "2d"}),
    ).select("reason").collect()
    assert [r[0] for r in rows] == [
        None, "bad_json", "bad_json", "bad_json", "missing_key", "null_company", "bad_min_exp",
        None, None, None, "bad_min_exp", "bad_min_exp",
    ]


@pytest.mark.parametrize(
    "given, years",
    [(3, 3), ("3", 3), (" 3 ", 3), (3.9, 3), (2.7, 2), ("10", 10), ("N/A", None), ("", None), (None, None), ("2+", None),
     (-1, -1), (1e30, None)],
)
def test_experience_years(spark, given, years):
    row = checked(spark, fenced({"min_exp": given})).first()
    assert row["min_exp_years"] == years


@pytest.mark.parametrize("given, flag", [(True, True), (False, False), ("False", False), ("TRUE", True), (0, None), (None, None)])
def test_flags(spark, given, flag):
    assert checked(spark, fenced({"visa_sponsorship": given})).first()["visa_sponsorship"] is flag


def test_good_and_quarantined_make_up_the_input(spark):
    rows = checked(spark, fenced(), "x", fenced({"min_exp": "a lot"}))
    good, bad = records.split_quarantine(rows)
    assert good.count() + bad.count() == 3
    assert sorted((r["link"], r["stage"], r["reason"]) for r in bad.collect()) == [
        ("l1", "parse", "bad_json"), ("l2", "suitability", "bad_min_exp"),
    ]


def test_legacy_answers_need_age_match(spark):
    texts = [fenced({"age_match": True}), fenced()]
    rows = records.parse_responses(answers(spark, *texts), legacy=True).orderBy("id").collect()
    assert [(r["age_match"], r["reason"]) for r in rows] == [("true", None), (None, "missing_key")]


def test_each_answer_is_parsed_once(spark, capsys):
    """Filters stay above the parse instead of repeating it."""
    kept = checked(spark, fenced()).filter("reason IS NULL AND citizenship_required = false AND min_exp_years < 3")
    kept.explain()
    plan = capsys.readouterr().out
    assert plan.count("from_json(") == 1
    assert plan.count("(?s)\\{.*\\}") == 1
