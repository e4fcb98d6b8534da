"""Fields of a posting read off its text and link by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number, perhaps a second one after a dash or "to", and years. Possessive quantifiers and the
# lookbehind keep the match linear on long digit runs, and a number's fraction is never one itself
_EXPERIENCE = (
    r"(?i)(?<![0-9.])([0-9]++(?:\.[0-9]++)?+)\s*+(\+|-|–|—|to\b)?+\s*+((?:[0-9]++(?:\.[0-9]++)?+)?+)\+?+\s*+"
    r"(?:or\s++more\s++)?+(?:years?|yrs?)\b"
)
# --- fixed values: phrases that decide the flags, matched in lower case ------------------------
_CITIZENSHIP = (
    "us citizenship required", "us citizenship is required", "must be a us citizen", "must be us citizens",
    "us citizens only", "requires us citizenship",
)
_CLEARANCE = (
    "security clearance required", "security clearance is required", "requires a security clearance",
    "must have a security clearance",
)
_NO_VISA = (
    "no visa sponsorship", "unable to sponsor", "not able to sponsor", "cannot sponsor", "can not sponsor",
    "do not sponsor", "does not sponsor", "will not sponsor", "without sponsorship",
)
# what denies a demand; taken out before the phrases above are looked for
_DENIED = r"\b(?:no|not an?) (?:active )?(?:security clearance|us citizenship)(?: is)? required"
# ----------------------------------------------------------------------------------------------


def company(link: Column) -> Column:
    """Host of the link, standing in for the employer; null if the link is no URL."""
    return F.try_parse_url(link, F.lit("HOST"))


def min_experience(text: Column) -> Column:
    return _experience(text, 1)


def max_experience(text: Column) -> Column:
    return _experience(text, 3)


def _experience(text: Column, group: int) -> Column:
    # the inner match is shared by both bounds; the outer one only looks at a few characters
    phrase = F.regexp_extract(text, _EXPERIENCE, 0)
    found = F.regexp_extract(phrase, _EXPERIENCE, group)
    return F.when(found != "", found).otherwise("N/A")


def citizenship_required(text: Column) -> Column:
    return _says(text, _CITIZENSHIP)


def security_clearance_required(text: Column) -> Column:
    return _says(text, _CLEARANCE)


def visa_sponsorship(text: Column) -> Column:
    return ~_says(text, _NO_VISA)


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    """One of the phrases occurs; plain substring search, which is far cheaper than a pattern."""
    lowered = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("u.s."), F.lit("us"))
    lowered = F.regexp_replace(lowered, _DENIED, "")
    return reduce(Column.__or__, (F.contains(lowered, F.lit(phrase)) for phrase in phrases))
