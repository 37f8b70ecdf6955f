"""Wall time of the headline queries, one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES "all" or a comma-separated list instead of the headline queries
"""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corrobora.plans.catalogue import QUERIES  # noqa: E402
from corrobora.session import build_session  # noqa: E402

HEADLINE = [
    "support_windows", "month_runs", "cite_last", "reconstructed", "service_overlaps", "find_orphans",
    "contribution_gaps", "findings", "claim_status", "plan_summary", "rejection_diagnoses",
    "proposal_checks", "verify_statements", "merge_deductors", "merge_passbooks", "last_contributions",
    "withdrawal_estimates", "assess_orphans", "statement_transactions", "bank_rows", "employer_pairs",
    "compare_names", "lint_letters",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the executors before the clock

    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)

    found = re.search(r"sf([\d.]+)", folder)
    line = {
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3),
        "unit": "sec", "queries": took, "sf": float(found.group(1)) if found else None}
    if "findings" in took:
        n = QUERIES["evidence_days"](spark, folder).selectExpr("sum(n_obs)").first()[0]
        line["observations_per_second"] = round(n / took["findings"])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
