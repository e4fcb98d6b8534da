"""URL filters by dated lists: an as-of join of captures with the entries active when they were fetched.

A list entry is (rule, since, action): from `since` on the rule has that action, until its next
entry. Entries become validity intervals. A capture meets the rules that name its host or a domain
above it, alone or with leading parts of its path; of the intervals active at its fetch time the one
with the longest rule decides.

Only column expressions and joins. Captures with the same address and time are one before the join,
and the join is on rule and period, so a host with a third of all captures meets few intervals each
and its partition can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days in a period of the join.
PERIOD = 30
BLOCK, ALLOW = "block", "allow"


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a last dot; empty where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path(url: Column) -> Column:
    """Path without query and fragment; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def rules(url: Column, depth: Column | int = 2**31 - 1) -> Column:
    """All rules an address may fall under: each domain it lies in, and its host with each part of its path.

    depth: the most parts of a path that a rule has; longer ones are not made.
    """
    labels = F.split(host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda p: p != ""), F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(host(url) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame, *, rule: str = "rule", since: str = "since", action: str = "action") -> DataFrame:
    """(rule, action, since, until) of dated entries; until is null for the last entry of a rule.

    Entries with a null rule, date or action are left out. Of entries of one rule with one date the
    one with the greatest action counts. Hosts are compared in lower case, paths as they are.
    """
    name = F.substring_index(F.col(rule), "/", 1)
    written = F.concat(F.lower(name), F.substring(F.col(rule), F.length(name) + 1, F.length(F.col(rule))))
    one = (
        entries.select(written.alias("rule"), F.col(since).cast("date").alias("since"), F.col(action).alias("action"))
        .where(F.col("rule").isNotNull() & F.col("since").isNotNull() & F.col("action").isNotNull())
        .groupBy("rule", "since").agg(F.max("action").alias("action"))
    )
    later = Window.partitionBy("rule").orderBy("since")
    return one.withColumn("until", F.lead("since").over(later))


def judge(
    captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched", keep: list[str], period: int = PERIOD,
) -> DataFrame:
    """One row per capture: the `keep` columns, rule, since and action of the deciding entry, and blocked.

    Rule, since and action are null, and blocked false, where no entry is active: also for a null or
    malformed address and a null time. Equal captures are judged alike, each in its own row. An
    empty list blocks nothing; an empty table gives an empty result; other columns are not read.
    """
    given = captures.select(F.struct(*keep).alias("_row"), F.col(url).alias("_url"), F.col(fetched).cast("date").alias("_at"))
    number = lambda day: F.floor(F.unix_date(day) / period)
    asked = given.select("_url", "_at").where(F.col("_url").isNotNull() & F.col("_at").isNotNull()).distinct()
    known = intervals(entries)
    # one number: how many slashes a rule of the list has
    depth = F.coalesce(known.agg(F.max(F.size(F.split("rule", "/")) - 1)).scalar(), F.lit(0))
    asked = asked.withColumn("_depth", depth).select(
        "_url", "_at", number(F.col("_at")).alias("_period"), F.explode(rules(F.col("_url"), F.col("_depth"))).alias("_rule")
    )
    # a rule's intervals are listed under the periods from the first to the last that asks for this rule
    spans = asked.groupBy("_rule").agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"))
    begin = F.greatest("since", "_from")
    end = F.least(F.coalesce(F.date_sub("until", 1), F.col("_to")), F.col("_to"))
    known = (
        known.join(spans, F.col("rule") == F.col("_rule")).drop("_rule").where(begin <= end)
        .withColumn("_in", F.explode(F.sequence(number(begin), number(end))))
    )
    met = asked.join(known, (F.col("_rule") == F.col("rule")) & (F.col("_period") == F.col("_in"))).where(
        (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    )
    best = met.groupBy("_url", "_at").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "since", "action")).alias("_best")
    ).select(F.col("_url").alias("_of"), F.col("_at").alias("_then"), "_best")
    return given.join(best, (F.col("_url") == F.col("_of")) & (F.col("_at") == F.col("_then")), "left").select(
        *[F.col("_row").getField(k).alias(k) for k in keep],
        F.col("_best.rule").alias("rule"), F.col("_best.since").alias("since"), F.col("_best.action").alias("action"),
        F.coalesce(F.col("_best.action") == BLOCK, F.lit(False)).alias("blocked"),
    )
