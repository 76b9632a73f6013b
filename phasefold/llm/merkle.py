"""Merkle fixity audit of WARC archives.

Records lie one after the other in archive files; every record's bytes give a
leaf digest.  Leaves are ordered by offset, and ``fan_out`` neighbours at a time
are hashed into the node above them (digests and the offset range they cover),
level by level, until every file has one root.  Two replicas are compared from
the top: only files whose roots differ are opened, and at each level only the
children of differing nodes are joined, so the work below the roots follows the
damage and not the archive.

All levels are group-bys on (file, ordinal / fan_out); ordinals come from
counts per slice of a file, so a file with a third of all records is many small
groups.  Node tables are written to the shared folder once per replica.

Defined results: null payloads are empty; records missing on one side are
reported with a null digest there; repeated rows are records of their own;
empty replicas agree; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from phasefold.llm.common import materialize

FAN_OUT = 16
SLICE = 4096


def warc_record(uri: Column, payload: Column, record_id: Column) -> Column:
    """One WARC/1.0 record as bytes: header, payload, two line ends."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def lay_out(records: DataFrame) -> DataFrame:
    """``records``: file, record_id, data (bytes).  Ordered by id in each file: file, ordinal, record_id, offset, length, digest; written once.

    Order and offsets come from slices of the id's range: sums over slices, then inside a slice.
    """
    leaves = materialize(records.select("file", "record_id", F.octet_length("data").cast("bigint").alias("length"), F.unhex(F.sha2("data", 256)).alias("digest")), "leaves")
    cell = F.floor(F.coalesce("record_id", F.lit(0)) / SLICE)
    leaves = leaves.withColumn("cell", cell)
    before = Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = leaves.groupBy("file", "cell").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).select(
        F.col("file").alias("f"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b_before"))
    inside = Window.partitionBy("file", "cell").orderBy(F.asc_nulls_first("record_id"), "digest")
    placed = leaves.withColumn("i", F.row_number().over(inside) - 1).withColumn(
        "at", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    joined = placed.join(cells, F.col("file").eqNullSafe(F.col("f")) & (F.col("cell") == F.col("c")))
    return materialize(joined.select("file", (F.col("n_before") + F.col("i")).alias("ordinal"), "record_id", (F.col("b_before") + F.col("at")).alias("offset"), "length", "digest"), "layout")


def tree(layout: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels from the leaves up, each: file, node, digest, from_offset, to_offset; the last has one node per file."""
    level = layout.select("file", F.col("ordinal").alias("node"), "digest", F.col("offset").alias("from_offset"), (F.col("offset") + F.col("length")).alias("to_offset"))
    levels = [level]
    largest = layout.agg(F.max("ordinal").alias("m")).first().m or 0
    while largest > 0:
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        packed = F.aggregate(children, F.lit("").cast("binary"), lambda a, c: F.concat(a, c["digest"]))
        span = F.concat_ws("-", F.min("from_offset"), F.max("to_offset")).cast("binary")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fan_out).alias("node")).agg(
            F.unhex(F.sha2(F.concat(span, packed), 256)).alias("digest"), F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset"))
        levels.append(materialize(up, "nodes"))
        largest //= fan_out
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose digest or range differ, or that only one side has: file, node."""
    right = b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("digest").alias("d"), F.col("from_offset").alias("lo"), F.col("to_offset").alias("hi"))
    joined = a.join(right, F.col("file").eqNullSafe(F.col("f")) & (F.col("node") == F.col("n")), "full")
    same = F.coalesce((F.col("digest") == F.col("d")) & (F.col("from_offset") == F.col("lo")) & (F.col("to_offset") == F.col("hi")), F.lit(False))
    return joined.filter(~same).select(F.coalesce("file", "f").alias("file"), F.coalesce("node", "n").alias("node"))


def audit(one: DataFrame, other: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Damaged places of two layouts: file, ordinal, record_id, offset, length, digest and the other side's record, offset, length and digest.

    Both are (file, ordinal, record_id, offset, length, digest) as from ``lay_out``.
    """
    left, right = tree(one, fan_out), tree(other, fan_out)
    depth = max(len(left), len(right))
    # a shorter tree has no nodes at the other's upper levels, so its files count as different there
    suspects = None
    for k in reversed(range(depth)):
        sides = [levels[k] if k < len(levels) else levels[-1].limit(0) for levels in (left, right)]
        if suspects is not None:
            wanted = suspects.select(F.col("file").alias("s_file"), F.col("node").alias("s_node"))
            sides = [s.join(wanted, F.col("file").eqNullSafe(F.col("s_file")) & (F.floor(F.col("node") / fan_out) == F.col("s_node")), "left_semi") for s in sides]
        suspects = materialize(_differing(*sides), "suspects")
    wanted = suspects.select(F.col("file").alias("s_file"), F.col("node").alias("s_node"))
    here = one.join(wanted, F.col("file").eqNullSafe(F.col("s_file")) & (F.col("ordinal") == F.col("s_node")), "left_semi")
    there = other.join(wanted, F.col("file").eqNullSafe(F.col("s_file")) & (F.col("ordinal") == F.col("s_node")), "left_semi").select(
        F.col("file").alias("o_file"), F.col("ordinal").alias("o_ordinal"), F.col("record_id").alias("other_id"), F.col("offset").alias("other_offset"),
        F.col("length").alias("other_length"), F.col("digest").alias("other_digest"))
    return here.join(there, F.col("file").eqNullSafe(F.col("o_file")) & (F.col("ordinal") == F.col("o_ordinal")), "full").select(
        F.coalesce("file", "o_file").alias("file"), F.coalesce("ordinal", "o_ordinal").alias("ordinal"), "record_id", "offset", "length", F.lower(F.hex("digest")).alias("digest"),
        "other_id", "other_offset", "other_length", F.lower(F.hex("other_digest")).alias("other_digest"))
