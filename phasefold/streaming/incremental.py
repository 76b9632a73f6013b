"""Incremental metrics and log refresh on Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from phasefold.operators.metrics import SWEEP_THRESHOLDS, with_metrics
from phasefold.operators.runlogs import parse_logs
from phasefold.session import ensure_checkpoint_dir
from phasefold.sources import log_versions


def running_counts(stream: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Confusion counts per score band, of a stream or of a batch; one row per band whatever arrives."""
    cuts = sorted({float(t) for t in thresholds})
    band = F.lit(0)
    for t in cuts:
        band = band + (F.col("prob") >= F.lit(t)).cast("int")
    return stream.groupBy(band.alias("band")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))


def sweep_from_bands(bands: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """All metrics per threshold from the band table."""
    cuts = sorted({float(t) for t in thresholds})
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("lvl")) for i, t in enumerate(cuts)]))
    spread = bands.withColumn("_l", levels)
    over = F.col("band") >= F.col("_l.lvl")
    total = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("bigint")
    return with_metrics(spread.groupBy(F.col("_l.threshold").alias("threshold")).agg(
        total(over, "pos").alias("tp"), total(~over, "neg").alias("tn"), total(over, "neg").alias("fp"), total(~over, "pos").alias("fn")))


def state_folder(df: DataFrame) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"


#: Batches after which the table of batch results is folded into one.
FOLD_EVERY = 64


def _drain(stream: DataFrame, out: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run what is available through ``write``; the checkpoint lies in the table's folder, so a later call goes on from there."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def _written(spark: SparkSession, out: str, kind: str) -> list[int]:
    """Numbers of the finished parts ``<out>/<kind>=<number>``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{kind}=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def read_counts(spark: SparkSession, out: str) -> DataFrame:
    """(band, pos, neg) of all finished batches of ``update_counts``."""
    folds = _written(spark, out, "fold")
    parts = [f"{out}/fold={folds[-1]}"] if folds else []
    parts += [f"{out}/batch={b}" for b in _written(spark, out, "batch") if not folds or b > folds[-1]]
    if not parts:
        return spark.createDataFrame([], "band int, pos bigint, neg bigint")
    return spark.read.schema("band int, pos bigint, neg bigint").parquet(*parts).groupBy("band").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def update_counts(stream: DataFrame, out: str, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Bring the table of confusion counts in ``out`` up to date with the stream, and return all metrics per threshold.

    A batch's counts go to a part of their own that a repeated batch overwrites, so a run that was stopped at any
    point goes on without losing or doubling rows.  Parts are a row per score band; every ``FOLD_EVERY`` batches they are
    folded into one.
    """
    spark = stream.sparkSession
    cuts = sorted({float(t) for t in thresholds})
    pairs = stream.select("y_true", "prob")

    def write(batch: DataFrame, number: int) -> None:
        running_counts(batch, cuts).coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number and number % FOLD_EVERY == 0:
            read_counts(spark, out).coalesce(1).write.mode("overwrite").parquet(f"{out}/fold={number}")

    _drain(pairs, out, write)
    return sweep_from_bands(read_counts(spark, out), cuts)


def stream_metrics(stream: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, out: str | None = None) -> DataFrame:
    """Final metrics after draining the stream; equals the batch answer.  ``out`` keeps the counts for the next call."""
    return update_counts(stream, out or state_folder(stream), thresholds)


def stream_logs(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Bring the table ``out`` up to date with the log files under ``path`` and return its newest state.

    New and grown files are one batch of file versions; only they are opened and parsed, and the batch is committed
    once.  Reads see the newest version of each file.  Without ``out`` the table is a new one in the checkpoint folder.
    """
    log_versions.register(spark)
    out = out or state_folder(spark.range(0))

    def write(batch: DataFrame, number: int) -> None:
        versions = batch.persist()  # parsed once; the batch is read from its files otherwise for each use
        parse_logs(versions).join(versions.select("log_file", "mtime", "size"), ["log_file", "mtime"]).write.mode("overwrite").parquet(f"{out}/batch={number}")
        versions.unpersist()

    _drain(spark.readStream.format("log_versions").load(path), out, write)
    parts = [f"{out}/batch={b}" for b in _written(spark, out, "batch")]
    kinds = "log_file string, mtime bigint, line int, key string, value double, text string, size bigint"
    stored = spark.read.schema(kinds).parquet(*parts) if parts else spark.createDataFrame([], kinds)
    newest = stored.groupBy("log_file").agg(F.max(F.struct("mtime", "size")).alias("_v"))
    return stored.join(newest, "log_file").where(F.struct("mtime", "size") == F.col("_v")).drop("_v", "size")
