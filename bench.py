"""Time the headline plans: one JSON line with seconds per plan.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each plan is built and run to its last row (rows are computed and dropped). The plans
first run once over the smallest tables beside the bench folder, so that the timings are
those of a session in use and not of a starting JVM; only the second pass is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from effectlab.plans.catalog import PLANS
from effectlab.session import local_session

HEADLINE = (
    "a1_describe_plain", "a1_describe", "a2_missingness", "j9_match_at_target", "a4_coverage", "a7_monotonicity",
    "b1_bootstrap_ci", "b1_bootstrap_ci_large", "b2_sign_flip_p", "b3_paired_contrasts", "b4_tolerance_contrasts",
    "b7_split_half", "w1_avg_rank", "w2_holm", "w3_first_per_key", "a10_quantile_summary", "a17_dedup_rows",
    "j3_key_audit", "j4_attestation_check", "j12_evidence_presence", "a14_run_audit", "c1_design_report",
    "v1_paired_direction", "v3_agreement", "v6_sweep", "v20_mig", "d2_measure_colour", "d3_ssim",
    "x22_gate", "s1_read_ledger", "t1_ingest_ledger",
)


def run(spark, sf: str, name: str) -> None:
    PLANS[name].build(spark, sf).write.format("noop").mode("overwrite").save()


def main(argv: list[str]) -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "effectlab-bench")
    names = argv or HEADLINE
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(small) else ():
        run(spark, small, name)
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(spark, sf, name)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    result = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
