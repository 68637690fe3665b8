"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data set, BENCH_CPUS the local cores. Each query runs to
completion into a sink that drops its rows; the better of two runs counts, so
that the start of the JVM's compiler is not part of the figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYTHONWARNINGS", "ignore")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.plans.queries import QUERIES  # noqa: E402
from corpusloom.session import build_session  # noqa: E402

HEADLINE = [
    "prepare_documents", "preprocess_rows", "preprocess_stats", "clean_text_aggressive", "exact_dedup",
    "chunk_sentences", "chunk_characters", "count_tokens", "tokenize_fixed_length", "column_profile",
    "dataset_stats", "validation_report", "template_alpaca", "corpus_bleu", "rouge_stemmed", "pair_scores",
    "evaluate_and_compare_models", "cached_models", "add_exports", "project_counts", "log_history",
    "gauge", "run_states", "curve_sample", "windowed_throughput", "gauge_stream",
]
RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "corpusloom.read.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
        "documents": rows,
    }
    if "preprocess_rows" in seconds:
        result["preprocess_rows_per_sec"] = round(rows / seconds["preprocess_rows"], 1)
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
