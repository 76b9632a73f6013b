"""Helpers the training-data operators share: shared scratch tables, text expressions, column names."""

from __future__ import annotations

import contextlib
import string
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from phasefold.session import ensure_checkpoint_dir

#: Java regex class of a word character: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


#: Paths of the scratch tables this driver has made, in order.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder, which every executor can reach."""
    SCRATCH.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers have finished."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside delete their shuffle files at once: what reads the written table has no use for them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, row order in a file is fixed."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As ``materialize``, laid out by the hash of ``key``: later joins and groupings on it move only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    name = f"scratch_{label}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def bucket_count(df: DataFrame) -> int:
    """Buckets for tables with a row per block: follows the input's splits."""
    spark = df.sparkSession
    return max(1, min(10_000, max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows of a run: 2 to this power.
RUN_BITS = 12


def numbered(df: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """A written copy whose rows are numbered, and the names of the columns with the number and its run of 4 096 numbers.

    The copy is laid out by run, so that ``without_rows`` doesn't move its rows.
    """
    row, run = free_name(df, "_row"), free_name(df, "_run")
    rows = df.withColumn(row, F.monotonically_increasing_id())
    return materialize_bucketed(rows.withColumn(run, F.shiftright(row, RUN_BITS)), label, run, bucket_count(df)), row, run


def without_rows(table: DataFrame, row: str, run: str, lost: DataFrame) -> DataFrame:
    """What ``numbered`` returned less the rows in the only column of ``lost``; only their numbers are shuffled, a list a run."""
    r, gone, number = free_name(table, "_r"), free_name(table, "_gone"), lost.columns[0]
    lists = lost.groupBy(F.shiftright(number, RUN_BITS).alias(r)).agg(F.collect_list(number).alias(gone))
    joined = table.join(lists.hint("shuffle_hash"), F.col(run) == F.col(r), "left")
    return joined.filter(F.col(gone).isNull() | ~F.array_contains(gone, F.col(row))).drop(row, run, r, gone)
