"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query runs once to warm up and once for the record, into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanwise.plans.catalog import QUERIES  # noqa: E402
from spanwise.plans.fixtures import table  # noqa: E402
from spanwise.session import build_session  # noqa: E402

HEADLINE = (
    "service_rollup", "trace_summaries", "incidents", "trace_shape", "trace_tree", "service_edges", "baselines", "baseline_verdict",
    "baseline_asof", "db_lock_candidates", "rca_generic", "merge_observations", "spans_from_otlp_json", "redact_text",
    "causal_order", "causality_violations", "identity_links", "process_journeys", "correlate_changes", "advisory_ranking",
    "check_drift", "boundary_compatibility", "investigations", "worklist_page", "verify_recovery", "ledger_verify", "settlements",
    "stream_service_health", "stream_sessions", "stream_async_stitch", "stream_verdicts",
)
REPLAYED = ("stream_verdicts",)
#: What the warm-up run leaves behind for the measured one (written tables of the fixtures).
PREWRITTEN = "the span and envelope fixtures are written by the warm-up run; the measured run reads them"


def run(spark, name: str, sf_dir: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        # The replay of the stream is what is timed, not reading its result; it has no warm-up.
        if name not in REPLAYED:
            run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rows = table(spark, sf_dir, "lineitem").count()
    total = round(sum(seconds.values()), 3)
    report = {
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir),
        "note": PREWRITTEN, "spans": rows, "spans_per_sec": {n: round(rows / s) for n, s in seconds.items()},
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
