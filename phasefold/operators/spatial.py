"""Cell index, half-open box joins, tile and brick lattices, centre selection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phasefold.functions.order import hash_take
from phasefold.session import BROADCAST_ROWS, cut_lineage, small_side

CELLS = ("ix", "iy", "iz")
POS = ("x", "y", "z")
CENTRE = ("cx", "cy", "cz")
BRICK = ("bi", "bj", "bk")
VOXEL = ("i", "j", "k")
AXES = ("ax", "ay", "az")


def cell_index(df: DataFrame, cell: float, by: Sequence[str] = ()) -> DataFrame:
    """Add ix, iy, iz = floor((pos - min corner) / cell), the corner taken per ``by`` group."""
    corner = df.groupBy(*by).agg(*[F.min(p).alias(f"_m{p}") for p in POS])
    joined = df.join(corner, list(by)) if by else df.join(F.broadcast(corner))
    return joined.withColumns({
        c: F.floor((F.col(p) - F.col(f"_m{p}")) / F.lit(float(cell))).cast("int") for c, p in zip(CELLS, POS)
    }).drop(*[f"_m{p}" for p in POS])


def cell_counts(df: DataFrame, cell: float) -> DataFrame:
    """Population of every occupied cell."""
    return cell_index(df.select(*POS), cell).groupBy(*CELLS).agg(F.count(F.lit(1)).alias("n"))


def box_condition(size: float, pos: Sequence[Column], centre: Sequence[Column]) -> Column:
    half = F.lit(0.5 * float(size))
    cond = F.lit(True)
    for p, c in zip(pos, centre):
        cond = cond & (p >= c - half) & (p < c + half)
    return cond


def explode_cells(df: DataFrame, size: float, cell: float, pos: Sequence[str] = CENTRE) -> DataFrame:
    """One row per origin-anchored cell that the box of ``size`` around ``pos`` touches."""
    for name, p in zip(CELLS, pos):
        lo = F.floor((F.col(p) - F.lit(0.5 * size)) / F.lit(float(cell)))
        hi = F.floor((F.col(p) + F.lit(0.5 * size)) / F.lit(float(cell)))
        df = df.withColumn(name, F.explode(F.sequence(lo, hi)))
    return df


def box_query(centres: DataFrame, points: DataFrame, size: float, cell: float | None = None, salts: int = 16) -> DataFrame:
    """Rows of ``points`` inside the half-open box around each centre (centre_id, cx, cy, cz).

    A range join rewritten as an equi-join on grid cells plus the exact residual
    predicate.  Centres at one place are searched once.  Few places are broadcast
    after counting; many are shuffled, each replicated over ``salts`` so that one
    crowded cell is spread over that many tasks.
    """
    centres = cut_lineage(centres)
    places = cut_lineage(centres.select(*CENTRE).distinct())
    if places.count() < centres.count():
        return each_centre(box_query(places, points, size, cell, salts), centres)
    if cell is None:  # a box touches 64 cells of a third or 27 of a half of its size
        cell = float(size) / (3.0 if 64 * places.count() <= BROADCAST_ROWS else 2.0)
    cell = float(cell)
    touched = explode_cells(centres, float(size), cell)
    keyed = points.withColumns({n: F.floor(F.col(p) / F.lit(cell)) for n, p in zip(CELLS, POS)})
    sized = small_side(touched)
    keys = list(CELLS)
    if sized is touched:
        sized = touched.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*POS), F.lit(salts)).cast("int"))
        keys.append("_salt")
    inside = box_condition(size, [F.col(p) for p in POS], [F.col(c) for c in CENTRE])
    return keyed.join(sized, keys).where(inside).drop(*keys)


def each_centre(found: DataFrame, centres: DataFrame) -> DataFrame:
    """What was found at a place (cx, cy, cz), for every centre there."""
    return found.join(small_side(centres), list(CENTRE))


def brick_occupancy(centres: DataFrame, points: DataFrame, size: float = 128.0, min_particles: int = 1024) -> DataFrame:
    """Class counts of each box that holds at least ``min_particles`` rows."""
    joined = box_query(centres.select(*CENTRE).distinct(), points.select(*POS, "is_stream"), size)
    counts = joined.groupBy(*CENTRE).agg(
        F.count_if(F.col("is_stream") == 1).alias("n_stream"), F.count_if(F.col("is_stream") != 1).alias("n_background"))
    counts = each_centre(cut_lineage(counts), centres).groupBy("centre_id").agg(
        F.sum("n_stream").alias("n_stream"), F.sum("n_background").alias("n_background"))
    return counts.where(F.col("n_stream") + F.col("n_background") >= min_particles)


def candidate_centres(points: DataFrame, cap: int | None = None, seed: int = 1) -> DataFrame:
    """Every row as a centre candidate; ``cap`` bounds them for training, with classes in the ratio 1:9."""
    if cap is None:
        return points.select(F.col("particle_id").alias("centre_id"), *[F.col(p).alias(c) for p, c in zip(POS, CENTRE)])
    stream = points.where("is_stream = 1")
    background = points.where("is_stream <> 1")
    n_stream = min(stream.count(), max(1, cap // 10))
    chosen = hash_take(stream, n_stream, seed=seed).unionByName(
        hash_take(background, max(1, cap - n_stream), seed=seed))
    return chosen.select(F.col("particle_id").alias("centre_id"), *[F.col(p).alias(c) for p, c in zip(POS, CENTRE)])


def touched_population(centres: DataFrame, points: DataFrame, size: float, cell: float) -> DataFrame:
    """Per centre, the summed population of all whole cells its box touches, over both class grids."""
    corners = points.groupBy("is_stream").agg(*[F.min(p).alias(f"m{p}") for p in POS])
    counts = cell_index(points.select("is_stream", *POS), cell, by=["is_stream"]).groupBy("is_stream", *CELLS).agg(
        F.count(F.lit(1)).alias("n"))
    # Centres whose boxes touch the same cells, class by class, share their sum: it is taken once per range of cells.
    ranges = {}
    for row, corner in enumerate(sorted(corners.where("is_stream IS NOT NULL").collect())):  # one row per class
        for p, c in zip(POS, CENTRE):
            for end, side in (("lo", -0.5 * size), ("hi", 0.5 * size)):
                ranges[f"_{end}{p}{row}"] = F.floor((F.col(c) + F.lit(side) - F.lit(corner[f"m{p}"])) / F.lit(float(cell))).cast("int")
        ranges[f"_class{row}"] = F.lit(corner["is_stream"])
    classes = sum(name.startswith("_class") for name in ranges)
    placed = centres.withColumns(ranges)
    places = placed.select(*ranges).distinct()
    spread = None
    for row in range(classes):
        part = places.withColumn("is_stream", F.col(f"_class{row}"))
        for name, p in zip(CELLS, POS):
            part = part.withColumn(name, F.explode(F.sequence(F.col(f"_lo{p}{row}"), F.col(f"_hi{p}{row}"))))
        spread = part if spread is None else spread.unionByName(part)
    if spread is None:
        return centres.limit(0).select("centre_id", *CENTRE, F.lit(0).cast("bigint").alias("touched"))
    sums = cut_lineage(spread.join(counts, ["is_stream", *CELLS]).groupBy(*ranges).agg(F.sum("n").alias("touched")))
    return placed.join(small_side(sums), list(ranges)).groupBy("centre_id", *CENTRE).agg(F.sum("touched").alias("touched"))


def valid_centres(points: DataFrame, size: float = 128.0, min_particles: int = 1024, target: int | None = None,
                  cap: int | None = None, cell: float | None = None, seed: int = 1) -> DataFrame:
    """Candidates whose touched cells hold enough rows: all of them, or the first ``target`` in hash order."""
    populated = touched_population(candidate_centres(points, cap, seed), points, size, size if cell is None else cell)
    valid = populated.where(F.col("touched") >= min_particles)
    return valid if target is None else hash_take(valid, target, key="centre_id", seed=seed)


def _holds(pos: Column, half: Column, centre: Column) -> Column:
    """The half-open interval around ``centre`` contains ``pos``."""
    return (pos >= centre - half) & (pos < centre + half)


def _swept(low: Column, half: Column, step: float, index: Column) -> Column:
    """Centre of a brick index along one axis of the sweep."""
    return low + half + index.cast("double") * F.lit(step)


def assign_tiles(df: DataFrame, size: float = 128.0, stride: float = 64.0) -> DataFrame:
    """Every (tile, row) pair of the origin-anchored tile lattice, with tile centres cx, cy, cz.

    Membership is arithmetic on the row itself, so no join and no shuffle.
    """
    half, step = F.lit(float(size) / 2.0), F.lit(float(stride))
    for t, c, p in zip(("ti", "tj", "tk"), CENTRE, POS):
        pos = F.col(p)
        span = F.sequence(F.floor((pos - half) / step).cast("int"), F.floor((pos + half) / step).cast("int"))
        df = df.withColumn(t, F.explode(span)).withColumn(c, F.col(t).cast("double") * step).where(_holds(pos, half, F.col(c)))
    return df


def tile_centres(df: DataFrame, size: float = 128.0, stride: float = 64.0, min_particles: int = 1,
                 strategy: str = "central_shell", max_tiles: int = 0) -> DataFrame:
    """Kept tiles (ti, tj, tk, centre, kind, n): origin tile first, then the lattice in order."""
    if strategy not in ("central_shell", "all"):
        raise ValueError(f"unknown tile strategy {strategy!r}")
    half = F.lit(float(size) / 2.0)
    central = F.lit(True)
    for p in POS:
        central = central & (F.abs(F.col(p)) < half)
    tiles = (
        assign_tiles(df.select(*POS).withColumn("_central", central), size, stride)
        .groupBy("ti", "tj", "tk", *CENTRE)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and("_central").alias("_inner"))
        .where(F.col("n") >= min_particles)
    )
    origin = (F.col("ti") == 0) & (F.col("tj") == 0) & (F.col("tk") == 0)
    tiles = tiles.withColumn("kind", F.when(origin, F.lit("central")).otherwise(F.lit("shell")))
    if strategy == "central_shell":
        tiles = tiles.where(origin | ~F.col("_inner"))
    tiles = tiles.drop("_inner")
    if max_tiles > 0:
        tiles = tiles.orderBy(F.when(origin, 0).otherwise(1), "ti", "tj", "tk").limit(max_tiles)
    return tiles


def brick_lattice(df: DataFrame, size: float = 128.0, stride_fraction: float = 0.5) -> DataFrame:
    """All brick centres of the overlapping sweep (bi, bj, bk, cx, cy, cz), made in parallel from the range of their numbers.

    An axis is swept from low + half to high + half (with 1e-6 of slack); no rows, no bricks.
    """
    step = float(size) * float(stride_fraction)
    if step <= 0:
        raise ValueError("stride_fraction must give a positive step")
    spark = df.sparkSession
    ends = df.agg(*[f(p) for p in POS for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return spark.createDataFrame([], "bi int, bj int, bk int, cx double, cy double, cz double")
    lows, highs = ends[::2], ends[1::2]
    counts = [max(math.ceil((high - low + 1e-6) / step) - 1, 0) + 1 for low, high in zip(lows, highs)]
    number, indices = F.col("id"), []
    for n in reversed(counts):
        indices.insert(0, F.pmod(number, F.lit(n)).cast("int"))
        number = F.floor(number / n)
    out = spark.range(math.prod(counts)).select(*[i.alias(b) for i, b in zip(indices, ("bi", "bj", "bk"))])
    return out.withColumns({c: _swept(F.lit(float(low)), F.lit(0.5 * size), step, F.col(b)) for c, low, b in zip(CENTRE, lows, ("bi", "bj", "bk"))})


def assign_bricks(df: DataFrame, size: float = 128.0, stride_fraction: float = 0.5) -> DataFrame:
    """Every (brick, row) pair of the sweep with the brick's centre; arithmetic, no shuffle of rows."""
    step = float(size) * float(stride_fraction)
    if step <= 0:
        raise ValueError("stride_fraction must give a positive step")
    corner = df.agg(*[f(p).alias(f"_{n}{p}") for p in POS for n, f in (("lo", F.min), ("hi", F.max))])
    df = df.join(F.broadcast(corner))  # one row
    half = F.lit(0.5 * float(size))
    for b, c, p in zip(("bi", "bj", "bk"), CENTRE, POS):
        pos, low, high = F.col(p), F.col(f"_lo{p}"), F.col(f"_hi{p}")
        last = F.greatest(F.ceil((high - low + F.lit(1e-6)) / F.lit(step)) - 1, F.lit(0)).cast("int")
        first = F.greatest(F.floor((pos - low - F.lit(float(size))) / F.lit(step)).cast("int"), F.lit(0))
        until = F.least((F.floor((pos - low) / F.lit(step)) + 1).cast("int"), last)
        span = F.sequence(F.least(first, until), until)
        df = df.withColumn(b, F.explode(span)).withColumn(c, _swept(low, half, step, F.col(b))).where(_holds(pos, half, F.col(c)))
    return df.drop(*[f"_{n}{p}" for p in POS for n in ("lo", "hi")])


def sweep_axes(df: DataFrame, size: float = 128.0, stride_fraction: float = 0.5, grid: int = 32) -> DataFrame:
    """Add ax, ay, az: along each axis the bricks of the sweep that hold the row, each as brick * grid + voxel.

    Rows with equal arrays share every (brick, voxel) they lie in, so they can be aggregated before the bricks
    multiply them, and answers come back to them in one list.  The columns _lox.. hold the low corner.
    """
    step = float(size) * float(stride_fraction)
    if step <= 0:
        raise ValueError("stride_fraction must give a positive step")
    ends = [0.0 if e is None else float(e) for e in df.agg(*[f(p) for p in POS for f in (F.min, F.max)]).first()]
    half, span, cols = F.lit(0.5 * float(size)), max(float(size), 1e-6), {}
    for a, p, lowest, highest in zip(AXES, POS, ends[::2], ends[1::2]):
        pos, low, last = F.col(p), F.lit(lowest), max(math.ceil((highest - lowest + 1e-6) / step) - 1, 0)
        first = F.greatest(F.floor((pos - low - F.lit(float(size))) / F.lit(step)).cast("int"), F.lit(0))
        until = F.least((F.floor((pos - low) / F.lit(step)) + 1).cast("int"), F.lit(last))
        first = F.least(first, until)
        codes = []
        for turn in range(math.ceil(float(size) / step) + 2):  # first..until has no more numbers
            brick = first + F.lit(turn)
            centre = _swept(low, half, step, brick)
            raw = F.floor((pos - (centre - half)) / F.lit(span) * F.lit(grid)).cast("int")
            voxel = F.least(F.greatest(raw, F.lit(0)), F.lit(grid - 1))
            codes.append(F.when((brick <= until) & _holds(pos, half, centre), brick * F.lit(grid) + voxel).otherwise(F.lit(-1)))
        cols[a] = F.array_remove(F.array(*codes), -1)
        cols[f"_lo{p}"] = low
    return df.withColumns(cols)


def sweep_places(cells: DataFrame, grid: int = 32) -> DataFrame:
    """One row per (brick, voxel) of each row of ``cells`` (ax, ay, az, ...), as bi, bj, bk, i, j, k."""
    for a, b, v in zip(AXES, BRICK, VOXEL):
        cells = cells.withColumn("_at", F.explode(a)).withColumns(
            {b: F.floor(F.col("_at") / F.lit(grid)).cast("int"), v: F.pmod(F.col("_at"), F.lit(grid))}).drop("_at")
    return cells


def brick_centre(size: float, stride_fraction: float) -> dict[str, Column]:
    """Centre columns of the brick numbers of a row made by ``sweep_axes``."""
    step = float(size) * float(stride_fraction)
    return {c: _swept(F.col(f"_lo{p}"), F.lit(0.5 * float(size)), step, F.col(b)) for c, p, b in zip(CENTRE, POS, BRICK)}
