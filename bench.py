"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodesieve.session import local_session  # noqa: E402
from lodesieve.workload import base, registry  # noqa: E402

HEADLINE = ("read_lines", "scan_rules", "scan_decoded", "scan_boundary", "pii_findings", "redact_text", "scan_files", "scan_records",
            "rotation_rollup", "score_overall", "audit_sensitive_paths", "match_advisories")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores, memory=os.environ.get("BENCH_MEMORY", "12g"), app="bench")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("read_lines")  # starts the executors' class loading and the parquet reader
    seconds = {name: run(name) for name in HEADLINE}
    lines = base.planted_lines(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "records": lines,
        "records_per_second_full_scan": round(lines / seconds["scan_files"])}))
    spark.stop()


if __name__ == "__main__":
    main()
