"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS
the timed runs after one warm-up. Queries run in full: all rows, all columns.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from raregrain.plans.catalogue import QUERIES
from raregrain.session import build_session

HEADLINE = [
    "category_token_totals", "token_features", "token_wide", "token_concat", "vocab_build", "vocab_documents",
    "document_tokens", "text_profile", "describe_distinct", "class_counts", "label_by_category",
    "class_weights_balanced", "feature_join", "exclude_keys", "stratified_split", "kfold", "sample_n_by_cut",
    "balanced_batches", "minibatch_stats", "confusion", "class_report", "average_precision", "auc_roc_exact",
    "threshold_search", "eval_before_after", "chunk_sink_roundtrip", "gbt", "logistic", "isolation_forest",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            spark.catalog.clearCache()
            if attempt:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "lineitem_rows": rows, "cpus": int(cpus), "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
