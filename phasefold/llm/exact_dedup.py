"""Exact dedup by a tree merge of sorted digest runs.

Every input split makes one sorted run of digests.  In each round a group of
``fan_in`` neighbouring runs is merged into one (run numbers are divided by the
fan-in, so the groups form a binomial tree); rows of a run are spread over tasks
by digest, so no task holds a whole run.  A run entry is keyed by a 64-bit hash
and *verified* by length and SHA-256: entries that share only the short hash
stay apart at every level.  An entry keeps the extreme identifier and the number
of rows.  On the way back the answer goes from the root to the first-level
entries and from there to the rows, so a text that a third of all rows share is
one entry per run and never one huge key.

Defined results: a null text counts as empty; a null id is smaller than any
other; of rows that agree in text and id exactly one stays; an empty table
gives an empty table; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from phasefold.llm.common import ascii_lower, materialize, numbered, without_rows

ENTRY = ["short", "n_bytes", "sha"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: id, row number, run, verified digest; written once, sorted inside each run."""
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (docs[row_col] if row_col else F.monotonically_increasing_id()).alias("row"),
        F.spark_partition_id().alias("run"),
        F.xxhash64(norm).alias("short"),
        F.octet_length(norm).alias("n_bytes"),
        F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"),
    )
    return materialize(rows.sortWithinPartitions("short", "sha"), "digests")


def _merge(entries: DataFrame, run: Column) -> DataFrame:
    return entries.groupBy(run.alias("run"), *ENTRY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(entries: DataFrame, n_runs: int, fan_in: int = 8) -> DataFrame:
    """Merge first-level entries round by round until one run is left."""
    while n_runs > 1:
        entries = _merge(entries, F.floor(F.col("run") / fan_in).cast("int"))
        n_runs = -(-n_runs // fan_in)
    return entries


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 8) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the lower-cased text).

    ``keep`` is "largest" or "smallest": which identifier of a group of equal texts stays.
    """
    return _judged(digest_runs(docs, id_col, text_col), keep, fan_in).drop("row")


def _judged(rows: DataFrame, keep: str, fan_in: int = 8) -> DataFrame:
    """What ``exact_groups`` returns, with the row number, from what ``digest_runs`` returns."""
    n_runs = (rows.agg(F.max("run").alias("m")).first().m or 0) + 1
    # ordered so that max() always finds the row that stays
    if keep == "largest":
        best = F.struct(F.col("doc_id").isNotNull().alias("real"), F.col("doc_id").alias("id"), F.col("row"))
    else:
        best = F.struct(F.col("doc_id").isNotNull().alias("real"), (-F.col("doc_id")).alias("id"), F.col("row"))
    first = _merge(rows.select("run", *ENTRY, best.alias("best"), F.lit(1).cast("bigint").alias("n")), F.col("run"))
    root = tree_merge(first, n_runs, fan_in).select(*ENTRY, "best", "n")
    answers = first.select("run", *ENTRY).join(root, ENTRY)
    keep_id = F.col("best.id") if keep == "largest" else -F.col("best.id")
    return rows.join(answers, ["run", *ENTRY]).select(
        "row",
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows that stay, with all their columns: of each group the row that ``exact_groups`` marks as kept."""
    table, row, run = numbered(docs, "rows")
    judged = _judged(digest_runs(table, id_col, text_col, row), keep)
    return without_rows(table, row, run, materialize(judged.filter(~F.col("kept")).select("row"), "copies"))
