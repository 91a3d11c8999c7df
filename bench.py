"""Headline-query benchmark.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Warms the JVM on sf0.001 with the same plans, then times each headline query
once at ``BENCH_SF_DIR`` (``BENCH_RUNS`` > 1 → median), materializing the full
result with the ``noop`` sink (no collect). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry import session  # noqa: E402
from quarry.plans.registry import load_all  # noqa: E402

HEADLINE = {
    "difficulty_mix": "difficulty_mix",             # token table + difficulty classes (E01, E04, E22-E26)
    "pair_scoring": "e41_score_table",              # pair scoring, ten components (E27-E42)
    "structure_round_trip": "f05_round_trip",       # structure/content round trip (F01, F02, F05)
    "first_valid": "f10_first_valid",               # first-valid selection (E16, F10)
    "exact_linking": "d13_exact_top2",              # exact value linking (D01, D06, D13)
    "fuzzy_linking": "d14_value_links",             # fuzzy value linking (D08-D13)
    "dialogue_flatten": "a03_cumulative_utterances",  # dialogue flatten + cumulative utterances (A02, A03)
    "duplicate_count": "b05_duplicates",            # duplicate count (B05)
    "join_chain": "g08_join_chain",                 # join / group / top-k construct (G08, G13, G16)
    "group_many": "g13_group_many",
    "top_k": "g16_top_k",
}


def run(plan, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    plan.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "1")))
    spark = session.build(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app="quarry-bench")
    plans = load_all()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm) and warm != sf_dir:
        for name in HEADLINE.values():
            run(plans[name], spark, warm)
    times = {}
    for key, name in HEADLINE.items():
        times[key] = round(statistics.median(run(plans[name], spark, sf_dir) for _ in range(runs)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
