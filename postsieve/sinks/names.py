"""Output names made from the parameters of a run."""

from __future__ import annotations

from datetime import date

from .. import dims

# --- fixed values: name patterns --------------------------------------------------------------
_SEARCH = "jobs_{geo_id}_{timeline}_{easy_apply}_{query}{suffix}.csv"
_RECOMMENDED = "jobs_recommended_{day}.csv"
_DAILY = "jobs_DAILY_{day}_{geo_id}_{easy_apply}_{query}.csv"
_DAY = "%d-%m-%Y"
# ----------------------------------------------------------------------------------------------


def search_name(query: str, location: str, timeline: str, easy_apply: bool, suffix: str = "") -> str:
    return _SEARCH.format(
        geo_id=dims.geo_id_of(location), timeline=timeline, easy_apply=easy_apply, query=query, suffix=suffix
    )


def recommended_name(day: date) -> str:
    return _RECOMMENDED.format(day=day.strftime(_DAY))


def daily_name(query: str, location: str, easy_apply: bool, day: date) -> str:
    return _DAILY.format(
        day=day.strftime(_DAY), geo_id=dims.geo_id_of(location), easy_apply=easy_apply, query=query
    )


def below(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"
