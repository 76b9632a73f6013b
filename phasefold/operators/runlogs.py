"""Training-log tables: parsing, merging of restarts, threshold sweeps, best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SWEPT = r"^(train|val)_thr([0-9]+p[0-9]+)_(.+)$"


def parse_logs(files: DataFrame) -> DataFrame:
    """(log_file, mtime, line, key, value, text) from one row per log file (log_file, mtime, value).

    The first line names the fields; lines with another field count are partial
    writes and are skipped; blank or non-numeric fields have value NaN.
    """
    lines = files.select("log_file", "mtime", F.split("value", "\r?\n").alias("_lines"))
    header = F.split(F.col("_lines")[0], r"\|")
    rows = lines.select("log_file", "mtime", header.alias("_h"), F.posexplode("_lines").alias("line", "_text")).where(
        (F.col("line") > 0) & (F.col("_text") != ""))
    rows = rows.withColumn("_v", F.split("_text", r"\|")).where(F.size("_v") == F.size("_h"))
    cells = rows.select("log_file", "mtime", "line", F.explode(F.arrays_zip(F.col("_h").alias("key"), F.col("_v").alias("text"))).alias("_c"))
    text = F.trim(F.col("_c.text"))
    number = F.coalesce(F.expr("try_cast(trim(_c.text) AS DOUBLE)"), F.lit(float("nan")))
    return cells.select("log_file", "mtime", "line", F.col("_c.key").alias("key"), number.alias("value"), text.alias("text"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Parse every log under ``path``; a log holds one line per epoch, so whole files are single rows."""
    raw = spark.read.text(path, wholetext=True)
    return parse_logs(raw.select(F.col("_metadata.file_path").alias("log_file"),
                                 F.unix_micros(F.col("_metadata.file_modification_time")).alias("mtime"), "value"))


def epochs_wide(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row per log line with the named fields as columns (epoch as integer)."""
    picked = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys]
    return cells.groupBy("log_file", "mtime", "line").agg(F.max(F.when(F.col("key") == "epoch", F.col("value"))).cast("int").alias("epoch"), *picked)


def _newest() -> list[Column]:
    cols = [F.col("mtime").desc(), F.col("log_file").desc()]
    return cols + [F.col("line").desc()]


def _with_line(logs: DataFrame) -> DataFrame:
    return logs if "line" in logs.columns else logs.withColumn("line", F.lit(0))


def log_concat(logs: DataFrame) -> DataFrame:
    return logs.orderBy("epoch", "mtime", "log_file")


def log_latest(logs: DataFrame) -> DataFrame:
    """Per epoch the row of the newest file."""
    keep = [c for c in logs.columns]
    newest = Window.partitionBy("epoch").orderBy(*_newest())
    return _with_line(logs).withColumn("_r", F.row_number().over(newest)).where("_r = 1").select(*keep)


def log_lineage(logs: DataFrame) -> DataFrame:
    """The newest file whole, preceded by older rows of epochs before its first."""
    keep = [c for c in logs.columns]
    last = logs.agg(F.max(F.struct("mtime", "log_file")).alias("_last"))
    first = logs.join(F.broadcast(last)).where(F.struct("mtime", "log_file") == F.col("_last")).agg(
        F.max("_last").alias("_last"), F.min("epoch").alias("_first"))
    usable = logs.join(F.broadcast(first)).where((F.struct("mtime", "log_file") == F.col("_last")) | (F.col("epoch") < F.col("_first")))
    return log_latest(usable.drop("_last", "_first")).select(*keep)


def swept_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, split, threshold, metric, value, pos) of every ``<split>_thrXpY_<metric>`` column."""
    import re

    swept = [c for c in wide.columns if re.match(SWEPT, c)]
    long = wide.select(*ids, F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in swept])).alias("pos", "_s"))
    name = F.col("_s.name")
    return long.select(*ids, "pos", F.regexp_extract(name, SWEPT, 1).alias("split"),
                       F.replace(F.regexp_extract(name, SWEPT, 2), F.lit("p"), F.lit(".")).cast("double").alias("threshold"),
                       F.regexp_extract(name, SWEPT, 3).alias("metric"), F.col("_s.value").alias("value"))


def best_swept(long: DataFrame, ids: list[str], split: str, metric: str) -> DataFrame:
    """Best value of a swept metric and its threshold; the first threshold wins ties, NaN never does.

    A row whose values are all missing keeps NaN in both columns.
    """
    nan = F.lit(float("nan"))
    asked = (F.col("split") == split) & (F.col("metric") == metric)
    usable = asked & ~F.isnan("value") & F.col("value").isNotNull()
    return long.where(asked).groupBy(*ids).agg(
        F.coalesce(F.max(F.when(usable, F.col("value"))), nan).alias("best_value"),
        F.coalesce(F.max_by(F.when(usable, F.col("threshold")), F.when(usable, F.struct("value", -F.col("pos")))), nan).alias("best_threshold"))


def best_epoch(rows: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """The row with the best value of a metric (earliest epoch on ties), NaN ignored."""
    scored = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return scored.orderBy(F.col(metric).desc() if maximize else F.col(metric).asc(), "epoch").limit(1)


def last_epochs(rows: DataFrame, n: int) -> DataFrame:
    """The last n epochs (all when n is 0)."""
    return rows.orderBy(F.col("epoch").desc()).limit(n) if n > 0 else rows
