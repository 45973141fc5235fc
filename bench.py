"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion into the no-op sink: once to warm up, then the median of $BENCH_REPEATS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "text_blocks",
    "html_to_text",
    "tokenize_words",
    "scrub_pii",
    "fixed_window_chunks",
    "parent_child_chunks",
    "ingest_chunks",
    "exact_duplicates",
    "hash_embed",
    "bm25_index",
    "bm25_score",
    "dense_topk",
    "hybrid_search",
    "rrf",
    "retrieval_metrics",
    "relevance_truth",
    "window_stats",
    "percentile_linear",
    "ks_drift",
    "sliding_rate_limit",
    "running_balance",
    "metrics_windows",
    "billing_report",
    "invoice_anomalies",
    "po_match",
    "risk_rollup",
    "paths",
    "text_diff",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    keys = sys.argv[1:] or HEADLINE

    from leafmill.registry import load_all
    from leafmill.session import get_spark

    spark = get_spark("leafmill-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()

    def run(key: str) -> float:
        t0 = time.perf_counter()
        registered[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("table_scan")
    times = {}
    for key in keys:
        warm = run(key)
        times[key] = round(statistics.median(run(key) for _ in range(repeats)), 3)
        print(f"{key}: warm-up {warm:.2f}s, run {times[key]:.2f}s", file=sys.stderr, flush=True)

    # One figure over the same rows throughout: documents cut into scrubbed, identified chunks.
    n_chunks = registered["ingest_chunks"](spark, sf_dir).count()
    prepared = times.get("ingest_chunks", 0)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "spark": spark.version,
                "chunks_prepared_per_sec": round(n_chunks / prepared, 1) if prepared else None,
            }
        )
    )


if __name__ == "__main__":
    main()
