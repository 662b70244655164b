"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line (seconds per query and their sum)."""
from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    # dashboard panels over the alert log
    "alert_kpis", "severity_distribution", "timeline_hourly", "top_source_ips", "sort_alerts",
    # evaluation
    "evaluate_model", "classification_report", "roc_curve",
    # preparation
    "median_impute", "dedup_rows", "stratified_split", "preprocess", "correlation_matrix",
    # distributions and windows
    "histogram_by_class", "kde_by_class", "flow_window_features",
    # streaming and the end-to-end run (prepare, select, train both models, detect, alert)
    "stream_detect", "run_pipeline",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from netwarden.session import build_session
    from netwarden.plans.catalog import QUERIES
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # JVM and parquet-reader warm-up outside the timings (a tiny table).
    spark.range(1).count()
    spark.read.parquet(os.path.join(sf_dir, "region.parquet")).count()
    times: dict[str, float] = {}
    pipeline = None
    for name in only or HEADLINE:
        t0 = time.time()
        if name == "run_pipeline":      # same work as the catalog query; keeps the models
            from netwarden.plans.catalog import _pipeline_flows
            from netwarden.plans.pipeline import run_pipeline
            pipeline = run_pipeline(_pipeline_flows(spark, sf_dir))
            df = pipeline.alerts
        else:
            df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    extra = {}
    if pipeline is not None:
        # Detection throughput: every cleaned flow, scaled by name, both models.
        from netwarden.operators.detect import detect
        flows = pipeline.prepared.data
        n = flows.count()
        t0 = time.time()
        detect(flows, pipeline.models).write.format("noop").mode("overwrite").save()
        dt = time.time() - t0
        extra = {"detect_rows": n, "detect_sec": round(dt, 3),
                 "detect_rows_per_sec": round(n / dt, 1) if dt > 0 else None}
        print(f"# detect: {n} rows in {dt:.2f}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), **extra}))


if __name__ == "__main__":
    main()
