"""Morton serialisation of grid cells and fixed-size patches along the curve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phasefold.functions.order import rank_in_buckets
from phasefold.operators.voxels import GRID

MAX_POSITION_BITS = 62


def axis_order(ndim: int, order: str = "z") -> list[int]:
    axes = list(range(ndim))
    orders = {"z": axes, "z-rev": axes[::-1], "z-evenodd": axes[0::2] + axes[1::2], "z-oddeven": axes[1::2] + axes[0::2]}
    if order not in orders:
        raise ValueError(f"unknown serial order {order!r}")
    return orders[order]


def serial_depth(df: DataFrame, columns: Sequence[str] = GRID) -> int:
    """Bits per axis needed for the largest coordinate (one small job)."""
    low, high = df.agg(F.min(F.least(*columns)), F.max(F.greatest(*columns))).first()
    if low is not None and low < 0:
        raise ValueError("grid coordinates must be non-negative")
    return max(1, (int(high or 0) + 1).bit_length())


def morton_code(columns: Sequence[str], depth: int, order: str = "z", batch: str | None = None, batch_bits: int = 1) -> Column:
    """Bit-interleaved BIGINT code; bit ``b`` of the ``d``-th ordered axis lands at ``b * ndim + d``."""
    ndim = len(columns)
    if depth * ndim > MAX_POSITION_BITS:
        raise ValueError(f"{ndim} axes of {depth} bits need {depth * ndim} position bits, {MAX_POSITION_BITS} available")
    if batch is not None and depth * ndim + batch_bits > 63:
        raise ValueError("no room for the batch bits")
    picked = [F.col(columns[a]).cast("bigint") for a in axis_order(ndim, order)]
    terms = [
        F.shiftleft(F.shiftright(axis, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * ndim + d)
        for bit in range(depth) for d, axis in enumerate(picked)
    ]
    code = terms[0]
    for term in terms[1:]:
        code = code.bitwiseOR(term)
    if batch is not None:
        code = F.shiftleft(F.col(batch).cast("bigint"), depth * ndim).bitwiseOR(code)
    return code


def morton_order(cells: DataFrame, orders: Sequence[str] = ("z",), columns: Sequence[str] = GRID, depth: int | None = None) -> DataFrame:
    """Add one ``code_<order>`` column per requested order."""
    depth = serial_depth(cells, columns) if depth is None else depth
    return cells.withColumns({f"code_{o.replace('-', '_')}": morton_code(columns, depth, o) for o in orders})


def serial_position(cells: DataFrame, chunk: Sequence[str], code: str, code_bits: int) -> DataFrame:
    """Zero-based position of each cell along its chunk's curve, computed per code prefix."""
    prefix = F.shiftright(F.col(code), max(code_bits - 16, 0))
    return rank_in_buckets(cells, chunk, prefix, [F.col(code)], name="position")


def serial_patches(cells: DataFrame, chunk: Sequence[str], code: str, patch_size: int, code_bits: int = MAX_POSITION_BITS) -> DataFrame:
    """Patches of ``patch_size`` consecutive cells.

    A chunk larger than one patch is filled up to a whole number of patches: the
    free slots of its last patch repeat the same slots of the patch before.
    """
    chunk = list(chunk)
    placed = serial_position(cells, chunk, code, code_bits)
    size = F.lit(int(patch_size)).cast("bigint")
    sizes = cells.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    placed = placed.join(sizes, chunk) if chunk else placed.join(F.broadcast(sizes))
    tail = F.pmod(F.col("_n"), size)
    last_full = F.col("_n") - tail - size
    borrowed = (F.col("_n") > size) & (tail > 0) & (F.col("position") >= last_full + tail) & (F.col("position") < last_full + size)
    own = F.struct(F.floor(F.col("position") / size).alias("patch"), F.pmod(F.col("position"), size).alias("slot"),
                   F.lit(False).alias("borrowed"))
    again = F.struct((F.floor(F.col("position") / size) + 1).alias("patch"), F.pmod(F.col("position"), size).alias("slot"),
                     F.lit(True).alias("borrowed"))
    slots = F.explode(F.when(borrowed, F.array(own, again)).otherwise(F.array(own)))
    return placed.withColumn("_slot", slots).select(*[c for c in placed.columns if c != "_n"], "_slot.*")
