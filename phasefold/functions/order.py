"""Exact order statistics, prefix sums and hash samples that stay distributed.

A window without (or with a hot) partition key runs in one task, and Spark's
exact ``percentile`` holds every distinct value in one buffer.  The helpers here
first cut the order into bounded buckets, settle the bucket level on a table of
bounded size, and only then look inside the buckets that matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from phasefold.functions.hashing import hash32
from phasefold.session import cut_lineage, small_side

HELD_ROWS = 1_000_000  # rows of one group that a single task may sort
SCAN_ROWS = 250_000  # rows of one partition of a prefix sum


def _between(low: Column, high: Column, frac: Column) -> Column:
    return F.when((frac == 0.0) | (low == high), low).otherwise((F.lit(1.0) - frac) * low + frac * high)


def held_quantiles(df: DataFrame, values: Sequence[str], qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles ``<value>_q0..`` of groups whose size is known to be small, by rank within the group.

    One shuffle serves all values; sorting beats the object buffers of the
    built-in ``percentile`` when there are many groups.
    """
    by = list(by)
    group = Window.partitionBy(*by)
    ranked, aggs = df.select(*by, *values), []
    for v in values:
        ranked = ranked.withColumns({f"_r_{v}": F.row_number().over(group.orderBy(F.col(v).asc_nulls_last())) - 1, f"_n_{v}": F.count(v).over(group)})
    for v in values:
        for i, q in enumerate(qs):
            pos = F.lit(float(q)) * (F.col(f"_n_{v}") - 1)
            at = lambda rank, v=v: F.max(F.when(F.col(f"_r_{v}") == rank, F.col(v)))
            aggs.append(_between(at(F.floor(pos)), at(F.least(F.floor(pos) + 1, F.col(f"_n_{v}") - 1)), F.max(pos - F.floor(pos))).alias(f"{v}_q{i}"))
    return ranked.groupBy(*by).agg(F.max(f"_n_{values[0]}").alias("n"), *aggs)


def _ordered_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_bits``: the 64 bits of ``_v`` as an integer of the same order."""
    for batch in batches:
        bits = (batch.column("_v").to_numpy() + 0.0).view(np.int64)  # -0.0 is 0.0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))], names=[*batch.schema.names, "_bits"])


def radix_quantiles(rows: DataFrame, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles of ``_v`` (no NULL, no NaN) by radix selection, columns n, q0.. per group.

    A double's bits, put in order, are four digits of 16 bits.  Each of four passes counts one digit of the rows that
    agree with a wanted rank in the digits before, so at most 65 536 counters stand for a group and prefix, whatever
    its rows; nothing is sorted and no group is held.
    """
    by = list(by)
    keyed = rows.select(*by, "_v").mapInArrow(_ordered_bits, ", ".join([*[f"`{c}` {k}" for c, k in rows.select(*by, "_v").dtypes], "_bits bigint"]))
    # the rows are read twice, for the first digit and for those that share it with a wanted rank; only the latter are written
    first = cut_lineage(keyed.groupBy(*by, F.shiftright("_bits", 48).alias("_digit")).agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_value")))
    sizes = first.groupBy(*by).agg(F.sum("_c").alias("n")).where("n > 0")
    ranks = []
    for i, q in enumerate(qs):
        low = F.floor(F.lit(float(q)) * (F.col("n") - 1))
        ranks += [F.struct(F.lit(2 * i).alias("_w"), low.alias("_left")), F.struct(F.lit(2 * i + 1).alias("_w"), F.least(low + 1, F.col("n") - 1).alias("_left"))]
    wanted = cut_lineage(sizes.select(*by, "n", F.inline(F.array(*ranks))).withColumn("_prefix", F.lit(0).cast("bigint")))
    keys = [*by, "_prefix"]
    for shift in (48, 32, 16, 0):
        top = shift == 48
        digit = F.shiftright("_bits", shift) if top else F.shiftright("_bits", shift).bitwiseAND(F.lit(0xFFFF))
        placed = keyed.withColumn("_prefix", F.lit(0).cast("bigint") if top else F.shiftright("_bits", shift + 16))
        if not top:
            placed = placed.join(small_side(wanted.select(*keys).distinct()), keys, "left_semi")
        if shift == 32:
            placed = cut_lineage(placed)
            keyed = placed.drop("_prefix")
        counts = placed.groupBy(*keys, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_value"))
        if top:
            counts = first.withColumn("_prefix", F.lit(0).cast("bigint"))
        until = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_digit"))  # at most 2^16 rows each
        cum = counts.withColumn("_until", until)
        hit = wanted.drop("_value").join(cum, keys).where((F.col("_until") - F.col("_c") <= F.col("_left")) & (F.col("_left") < F.col("_until")))
        prefix = F.col("_digit") if top else F.shiftleft("_prefix", 16) + F.col("_digit")
        wanted = cut_lineage(hit.select(*by, "n", "_w", (F.col("_left") - F.col("_until") + F.col("_c")).alias("_left"), prefix.alias("_prefix"), "_value"))
    at = lambda w: F.max(F.when(F.col("_w") == w, F.col("_value")))
    out = []
    for i, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.max("n") - 1)
        out.append(_between(at(2 * i), at(2 * i + 1), pos - F.floor(pos)).alias(f"q{i}"))
    picked = wanted.groupBy(*by).agg(F.max("n").alias("n"), *out)
    return picked if by else picked.where("n IS NOT NULL")


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = (), held_rows: int = HELD_ROWS) -> DataFrame:
    """Linear-interpolated exact quantiles, columns ``q0..`` per group (and ``n``).

    Small groups are ranked, one shuffle in all; larger ones go through radix selection.  Both interpolate alike.  NULL
    and NaN values are ignored.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if largest_group(rows, by) > held_rows:
        return radix_quantiles(rows, qs, by)
    held = held_quantiles(rows, ["_v"], qs, by)
    return held.select(*by, "n", *[F.col(f"_v_q{i}").alias(f"q{i}") for i in range(len(qs))])


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Rows of the largest group (one job over the key columns)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def prefix_sums(df: DataFrame, order: str, sums: Mapping[str, str], descending: bool = False, by: Sequence[str] = (),
                part_rows: int = SCAN_ROWS) -> DataFrame:
    """Inclusive cumulative sums over an order of values unique per group.

    ``sums`` maps output name to summed column.  Rows are cut into range partitions of about ``part_rows`` rows, so
    their number grows with the data; partition totals, one row each, give every partition its offset, and inside a
    partition sums run on.
    """
    by = list(by)
    held = cut_lineage(df)
    parts = max(1, -(-held.count() // part_rows))
    cut = cut_lineage(held.repartitionByRange(parts, *by, order).withColumn("_part", F.spark_partition_id()))
    totals = cut.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    key = F.col("_part").desc() if descending else F.col("_part").asc()
    before = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inner = Window.partitionBy(*by, "_part").orderBy(F.col(order).desc() if descending else F.col(order).asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        cut.join(small_side(offsets), [*by, "_part"])
        .withColumns({n: F.col(f"_o_{n}") + F.sum(c).over(inner) for n, c in sums.items()})
        .drop("_part", *[f"_o_{n}" for n in sums])
    )


#: Rows that one task aggregates or sorts, where the rows are counted.
TASK_ROWS = 250_000


def task_parts(spark: SparkSession, n_rows: int) -> int | None:
    """Partitions of about ``TASK_ROWS`` rows; None where the session's number of partitions makes them no larger."""
    parts = -(-n_rows // TASK_ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread_rows(df: DataFrame, parts: int | None, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by ``keys`` into ``parts`` partitions; as they are without a number."""
    return df.repartition(parts, *keys) if parts else df


def rank_in_buckets(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank",
                    take: Column | None = None, parts: int | None = None) -> DataFrame:
    """Zero-based rank per group, computed per (group, bucket) plus a bucket offset.

    ``bucket`` must be monotone in ``order`` and take a bounded number of values
    per group.  With ``take`` only the first ``take`` rows of a group are kept,
    and rows of buckets wholly past it are not ranked.  With ``parts`` rows and
    counts are shuffled into so many partitions, else into the session's number.
    """
    by = list(by)
    tagged = spread_rows(df.withColumn("_bucket", bucket), parts, [*by, "_bucket"])
    counts = tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread_rows(counts, parts, by).select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    placed = tagged.join(offsets, by + ["_bucket"])
    if take is not None:
        placed = placed.where(F.col("_off") < take)
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = placed.withColumn(name, F.col("_off") + F.row_number().over(inner) - 1)
    if take is not None:
        ranked = ranked.where(F.col(name) < take)
    return ranked.drop("_bucket", "_off")


def row_hash(df: DataFrame, key: str, seed: int) -> Column:
    """The hash of a row, or the ``_hash`` column computed earlier (before a join multiplied the rows)."""
    return F.col("_hash") if "_hash" in df.columns else hash32(key, seed)


def hash_bucket_counts(df: DataFrame, by: Sequence[str], key: str, seed: int, take: Column | None = None) -> tuple[DataFrame, int]:
    """Rows per (group, hash bucket), and the shift that cuts a hash into its bucket.

    64 buckets usually do; when one still holds too many rows for a single task
    the cut is made finer.  The table is small and is materialised, so the data
    is read once for it.
    """
    extra = [F.max(take).alias("_take")] if take is not None else []
    for bits in (6, 12, 20, 32):
        shift = 32 - bits
        tagged = df.withColumn("_bucket", F.shiftright(row_hash(df, key, seed), shift))
        counts = cut_lineage(tagged.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"), *extra))
        if bits == 32 or (counts.agg(F.max("_n")).first()[0] or 0) <= HELD_ROWS:
            return counts, shift
    raise AssertionError("unreachable")


def take_buckets(df: DataFrame, counts: DataFrame, shift: int, by: Sequence[str], key: str, seed: int, rank: str | None = "_rank") -> DataFrame:
    """First ``_take`` rows of each group in hash order, given its bucket counts (with ``_take``).

    Buckets wholly past the wanted rows are dropped by the join, before any row
    is shuffled for ranking.  Without a ``rank`` column, rows of buckets wholly
    within them are not ranked either: only one bucket of a group is.
    """
    by = list(by)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_off") < F.col("_take"))
    tagged = df.withColumn("_h", row_hash(df, key, seed)).withColumn("_bucket", F.shiftright(F.col("_h"), shift))
    if rank is None:
        past = F.col("_off") + F.col("_n") > F.col("_take")
        ends = cut_lineage(offsets.groupBy(*by).agg(
            F.max(F.when(~past, F.col("_bucket"))).alias("_until"), F.max(F.when(past, F.col("_bucket"))).alias("_edge"),
            F.max(F.when(past, F.col("_off"))).alias("_off"), F.max("_take").alias("_take")))
        near = tagged.join(small_side(ends), by) if by else tagged.join(F.broadcast(ends))
        whole = near.where(F.col("_bucket") <= F.col("_until"))
        order = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
        cut = near.where(F.col("_bucket") == F.col("_edge")).withColumn("_rn", F.row_number().over(order))
        cut = cut.where(F.col("_rn") <= F.col("_take") - F.col("_off")).drop("_rn")
        return whole.unionByName(cut).drop("_h", "_hash", "_bucket", "_until", "_edge", "_off", "_take")
    placed = tagged.join(small_side(offsets.select(*by, "_bucket", "_off", "_take")), [*by, "_bucket"])
    inner = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    ranked = placed.withColumn(rank, F.col("_off") + F.row_number().over(inner) - 1)
    return ranked.where(F.col(rank) < F.col("_take")).drop("_h", "_hash", "_bucket", "_off", "_take")


def hash_take(df: DataFrame, n: Column | int, by: Sequence[str] = (), key: str = "particle_id", seed: int = 0,
              rank: str | None = None) -> DataFrame:
    """Exactly ``min(n, size)`` rows per group without replacement, in hash order."""
    limit = F.lit(n) if isinstance(n, int) else n
    counts, shift = hash_bucket_counts(df, by, key, seed, limit)
    return take_buckets(df, counts, shift, by, key, seed, rank)
