"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the number of local cores. Each query runs
once into a no-op sink, so every row and column is computed; one small run beforehand starts the
JVM.
"""

from __future__ import annotations

import json
import os
import time

from tidegate.plans.catalog import QUERIES
from tidegate.session import local_session

HEADLINE = (
    "rule_stage",
    "pattern_first_hit",
    "crisis_first_hit",
    "keyword_all_hits",
    "keyword_ngram_join",
    "validate_prompts",
    "json_intake",
    "profile_default",
    "profile_full",
    "profile_full_scored",
    "merge_long",
    "trace_flat",
    "verdict_rollup",
    "stage_funnel",
    "stream_screen",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, max(8, cores))
    QUERIES["rule_stage"](spark, sf_dir).limit(1).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall-clock of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
