"""Split/class directory scan and per-file row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SPLITS = ("training", "validation", "testing")
CLASSES = {"streams": 1, "background": 0}


def scan_splits(spark: SparkSession, root: str, splits: Sequence[str] = SPLITS, layout: str = "plain") -> DataFrame:
    """All rows under ``<root>/<split>/<class>`` with split, is_stream and file_path columns.

    Layouts: ``plain`` and ``hive`` for Parquet, ``npy`` for matrix files (file_id instead of file_path).
    Each directory is its own scan with constant split and class, so a filter on
    either prunes whole directories.  A missing or empty directory is an error.
    """
    if layout == "npy":
        from phasefold.sources import matrix_files

        return matrix_files.read_tree(spark, root, splits)
    parts = []
    for split in splits:
        for name, flag in CLASSES.items():
            folder = f"{root}/{split}/{name}" if layout == "plain" else f"{root}/split={split}/class={name}"
            try:
                part = spark.read.parquet(folder)
            except AnalysisException as err:
                raise RuntimeError(f"missing data directory: {folder}") from err
            if part.limit(1).count() == 0:
                raise RuntimeError(f"no rows in {folder}")
            parts.append(part.withColumns({"split": F.lit(split), "is_stream": F.lit(flag), "file_path": F.col("_metadata.file_path")}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_splits(df: DataFrame, root: str) -> None:
    """Lay a table with split and is_stream out in the scanned directory form."""
    named = df.withColumn("class", F.when(F.col("is_stream") == 1, "streams").otherwise("background")).drop("is_stream")
    named.write.mode("overwrite").partitionBy("split", "class").parquet(root)


def file_sizes(df: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Rows per source file, the sampling unit."""
    return df.groupBy(F.col(file_col).alias("file_id")).agg(F.count(F.lit(1)).alias("n_rows"))
