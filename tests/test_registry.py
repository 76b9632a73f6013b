import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"
QUICK = ["phase_columns", "dedup_first", "box_query", "knn_exact", "patch_features16", "patch_expand", "brick_voxels", "sparse_cells6",
         "cell_hash_cap", "serial_patches", "chunk_table", "tiled_inference", "alloc_sqrt", "sample_per_file", "select_top_fraction", "threshold_sweep",
         "roc_auc", "loss_tanimoto", "density_products", "component_catalogue", "best_swept", "stream_metrics"]


def test_every_check_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUICK) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    line = compare(spark, name, SF, con)
    assert line.startswith("ok"), line


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 500 and {"prob", "pred_label", "patch_l_align"} <= set(out.columns)
