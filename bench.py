"""Headline timings: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from phasefold.plans.registry import QUERIES  # noqa: E402
from phasefold.session import local_session  # noqa: E402

HEADLINE = [
    "phase_columns", "dedup_first", "dimensionless", "sample_per_file", "select_top_fraction", "threshold_sweep", "roc_auc", "avg_precision",
    "box_query", "brick_occupancy", "knn_exact", "knn_volume", "patch_features16", "patch_expand", "brick_voxels", "edge_blend", "sparse_cells6",
    "cell_to_particle", "serial_patches", "chunk_table", "tile_centres", "gaussian_blend", "tiled_inference", "density_products", "component_catalogue",
    "gbt_train_score", "gbt_infer", "batch_score", "tile_scorer", "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
