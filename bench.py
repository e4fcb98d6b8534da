"""Headline queries, timed: one warm-up, then the median of three runs, in wall seconds.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postsieve import build_session, use_checkpoint_dir  # noqa: E402
from sfqueries import catalog  # noqa: E402

HEADLINE = (
    "daily_digest",
    "daily_digest_text",
    "first_seen_dedupe",
    "union_scans",
    "page_position",
    "html_to_text",
    "classify",
    "match_score_vector",
    "match_score_text",
    "recommended",
    "search",
    "parse_response",
)
# tables whose rows a query reads, for rows per second
INPUTS = {
    "daily_digest": ("pages", "events"), "daily_digest_text": ("pages", "events"),
    "first_seen_dedupe": ("events",), "union_scans": ("events",), "page_position": ("events",),
    "html_to_text": ("pages",), "classify": ("pages",), "match_score_vector": ("embeddings",),
    "match_score_text": ("pages",), "recommended": ("pages",), "search": ("pages", "events"),
    "parse_response": ("events",),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_checkpoint_dir(spark)
    queries = catalog.queries()
    counts = {
        table: spark.read.parquet(f"{sf_dir}/{table}.parquet").count() for table in ("pages", "events", "embeddings")
    }
    seconds, rates = {}, {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(sum(counts[t] for t in INPUTS.get(name, ("pages",))) / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total_wall_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
