"""Model answers: fence removal, parsing, typing, and why an answer is unusable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims, schemas

_NUMBER = r"^\s*[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?\s*$"


def strip_fence(response: Column) -> Column:
    """The JSON object inside an answer, fenced or not; empty if there is none."""
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def parse_answer(body: Column, legacy: bool = False) -> Column:
    """The answer as a struct of text fields."""
    return F.from_json(body, schemas.LEGACY_RESPONSE if legacy else schemas.RESPONSE)


def absent_keys(body: Column, legacy: bool = False) -> Column:
    """How many keys an answer lacks; null if it is no JSON object.

    A null value and an absent key look alike after parsing, so this looks at the JSON text.
    """
    keys = schemas.RESPONSE_KEYS + (("age_match",) if legacy else ())
    return F.array_size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(body)))


def answer_problem(absent: Column, company: Column) -> Column:
    """Why an answer cannot become a record, or null."""
    return (
        F.when(absent.isNull(), "bad_json")
        .when(absent > 0, "missing_key")
        .when(company.isNull(), "null_company")
    )


def experience_years(raw: Column) -> Column:
    """Whole years in an experience value; null if it is not a number."""
    number = F.when(raw.rlike(_NUMBER), F.trim(raw)).try_cast("double")
    return number.try_cast("int")


def experience_unstated(raw: Column) -> Column:
    return raw.isNull() | raw.isin(*dims.NO_EXPERIENCE)


def experience_problem(raw: Column, years: Column) -> Column:
    return F.when(~experience_unstated(raw) & years.isNull(), "bad_min_exp")


def flag(raw: Column) -> Column:
    text = F.lower(raw)
    return F.when(text == "true", True).when(text == "false", False)
