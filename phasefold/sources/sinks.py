"""Prediction tables and run metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasefold.operators.blending import threshold_masks
from phasefold.operators.metrics import MASK_THRESHOLDS
from phasefold.session import cut_lineage


def write_predictions(df: DataFrame, path: str, group: str, expected_rows: int | None = None,
                      thresholds: Sequence[float] = MASK_THRESHOLDS) -> None:
    """Write one prediction group (probability plus threshold masks) under ``path/group=...``.

    Refuses to add a group whose row count differs from the source's.
    """
    if expected_rows is not None:
        df = cut_lineage(df)  # counted and written from one computation
        rows = df.count()
        if rows != expected_rows:
            raise ValueError(f"prediction group has {rows} rows, the source has {expected_rows}")
    threshold_masks(df, thresholds).write.mode("overwrite").parquet(f"{path}/group={group}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def particle_outputs(scored: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """The rich per-particle output set, one wide row per particle."""
    base = ["particle_id", "x", "y", "z", "vx", "vy", "vz", "r", "vr", "mass", "prob", "logit", "margin"]
    return scored.select(*base, F.col("selected").cast("tinyint").alias("pred_label"), *features)


def save_stats(stats: DataFrame, path: str) -> None:
    """One-row statistics as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def load_stats(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)
