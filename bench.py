"""Seconds per headline query, warm, median of three (one run where the warm-up took over 4 s); prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from terrastat import plans  # noqa: E402
from terrastat.session import get_session  # noqa: E402

HEADLINE = [
    "flagship_index_classes",
    "agg_02_describe_missing",
    "agg_09_grouping_sets",
    "agg_10_pearson_pairs",
    "agg_14_regression_metrics",
    "agg_21_box_statistics",
    "agg_24_spearman",
    "win_03_holm",
    "win_05_outer_folds",
    "win_07_gap_fill",
    "win_08_rolling_mean",
    "join_01_nearest_pixel",
    "join_08_nearest_neighbours",
    "join_09_point_in_polygon",
    "spa_03_semivariogram",
    "spa_07_local_kriging",
    "spa_14_class_assignment",
    "ml_06_indicator_weights",
    "ml_09_vif_elimination",
    "ml_11_training_medians",
    "ml_15_forest",
    "mix_02_fixed_effects",
    "mix_06_likelihood_ratio",
    "mix_19_figure_annotations",
    "mix_23_run_summary",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, shuffle_partitions=int(cpus))
    times = {}
    for name in HEADLINE:
        first = seconds(spark, name, folder)  # warm-up
        runs = 3 if first < 4 else 1
        times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))


if __name__ == "__main__":
    main()
