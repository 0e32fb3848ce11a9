"""Wall seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_RUNS the timed runs (median),
BENCH_WARMUP the untimed runs per query before them (on BENCH_WARMUP_DIR, the smallest tables, so
that code is compiled and no data is cached), BENCH_QUERIES (comma separated) the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from emberline.catalog import QUERIES
from emberline.session import build_session

HEADLINE = [
    "first_activation", "pipe_activation", "pipe_activation_long", "dedup_first", "weekly_counts",
    "history_broadcast_join", "cohort_window_history", "pre_activation_history", "weak_cohort_window",
    "interaction_counts", "pipe_interactions", "pipe_person_period", "sociodemo_score", "quartile_membership",
    "news_class_day", "rolling_mean_lagged", "pipe_news_exposure", "control_sample", "pipe_feature_table",
    "pipe_design_matrix", "theme_token_topk", "pca_logistic", "cox_ph", "concordance",
]


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", cpus, **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    warmup = int(os.environ.get("BENCH_WARMUP", "1"))
    warmup_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    seconds = {}
    for name in names:
        for _ in range(warmup):
            run(QUERIES[name], spark, warmup_dir)
        seconds[name] = round(statistics.median(run(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
