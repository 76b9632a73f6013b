"""Dense-brick and sparse six-dimensional cell aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phasefold.functions.order import rank_in_buckets, spread_rows
from phasefold.functions.phase import feature_stats
from phasefold.operators.spatial import AXES, BRICK, VOXEL, brick_centre, sweep_axes, sweep_places
from phasefold.session import cut_lineage, small_side

RAW_KEY = tuple(f"f{d}" for d in range(6))
GRID = tuple(f"g{d}" for d in range(6))
COORD6 = tuple(f"c{d}" for d in range(6))
ORIGIN = ("ox", "oy", "oz")
CHANNELS_7 = ("vx", "vy", "vz", "r", "vr", "vt")
CHANNELS_11 = CHANNELS_7 + ("lx", "ly", "lz", "lmag")

SCORED_CELLS = 500_000  # cells whose values are broadcast to the rows, at most some 100 bytes each

# Per-axis multipliers of the cell hash.
HASH_PRIMES = (73856093, 19349663, 83492791, 2654435761, 97531, 314159)


def voxel_index(df: DataFrame, size: float = 128.0, grid: int = 32) -> DataFrame:
    """i, j, k of each row inside its brick, from the brick centre columns."""
    span = max(float(size), 1e-6)
    cols = {}
    for v, p, c in zip(VOXEL, ("x", "y", "z"), ("cx", "cy", "cz")):
        low = F.col(c) - F.lit(0.5 * float(size))
        raw = F.floor((F.col(p) - low) / F.lit(span) * F.lit(grid)).cast("int")
        cols[v] = F.least(F.greatest(raw, F.lit(0)), F.lit(grid - 1))
    return df.withColumns(cols)


def brick_voxels(df: DataFrame, stats: DataFrame | None = None, size: float = 128.0, grid: int = 32,
                 angular_momentum: bool = True, brick: Sequence[str] = BRICK) -> DataFrame:
    """Occupied voxels of each brick: log count, mean standardised channels, strict-majority target.

    ``df`` carries the brick key, its centre and level-14 phase columns.
    Standardising is linear, so means are taken raw in one hash aggregate and
    shifted and scaled afterwards.
    """
    channels = CHANNELS_11 if angular_momentum else CHANNELS_7
    if stats is None:
        stats = feature_stats(df, channels)
    agg = voxel_index(df, size, grid).groupBy(*brick, *VOXEL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_stream") == 1).alias("n_stream"),
        *[F.avg(c).alias(c) for c in channels])
    return _standardised(agg, stats, [*brick, *VOXEL], channels)


def _standardised(agg: DataFrame, stats: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """The voxel table of raw means, n and n_stream."""
    agg = agg.join(F.broadcast(stats.select(*[f"{c}_{s}" for c in channels for s in ("mean", "std")])))
    return agg.select(
        *keys, "n", F.log1p(F.col("n").cast("double")).alias("log_count"),
        *[((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"mean_{c}") for c in channels],
        (F.col("n_stream") * 2 > F.col("n")).cast("int").alias("target"),
    )


def swept_sums(rows: DataFrame, channels: Sequence[str] = (), grid: int = 32) -> DataFrame:
    """n, n_stream and raw means of every voxel of the sweep, from rows made by ``sweep_axes``.

    Rows are summed on the places they share before the overlapping bricks multiply anything.
    """
    known = [F.count(c).alias(f"_n_{c}") for c in channels]
    cells = rows.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_stream") == 1).alias("n_stream"),
                                    *[F.sum(c).alias(c) for c in channels], *known)
    return sweep_places(cells, grid).groupBy(*BRICK, *VOXEL).agg(
        F.sum("n").alias("n"), F.sum("n_stream").alias("n_stream"), *[(F.sum(c) / F.sum(f"_n_{c}")).alias(c) for c in channels])


def swept_voxels(df: DataFrame, stats: DataFrame | None = None, size: float = 128.0, stride_fraction: float = 0.5, grid: int = 32,
                 angular_momentum: bool = True) -> DataFrame:
    """``brick_voxels`` of all bricks of the sweep over ``df`` (level-14 rows)."""
    channels = CHANNELS_11 if angular_momentum else CHANNELS_7
    stats = feature_stats(df, channels) if stats is None else stats
    sums = swept_sums(sweep_axes(df, size, stride_fraction, grid), channels, grid)
    return _standardised(sums, stats, [*BRICK, *VOXEL], channels)


def voxel_to_particle(rows: DataFrame, scored: DataFrame, values: Sequence[str], size: float = 128.0, stride_fraction: float = 0.5,
                      grid: int = 32) -> DataFrame:
    """(particle_id, x, y, z, cx, cy, cz, values...) for each row made by ``sweep_axes`` and each brick that holds it.

    The answers of a place travel as one list, so a row is shuffled once and not once a brick.
    """
    places = rows.select(*AXES).distinct()
    answers = sweep_places(places, grid).join(scored.select(*BRICK, *VOXEL, *values), [*BRICK, *VOXEL])
    lists = answers.groupBy(*AXES).agg(F.collect_list(F.struct(*BRICK, *values)).alias("_answers"))
    low = [f"_lo{p}" for p in ("x", "y", "z")]
    pairs = rows.select("particle_id", "x", "y", "z", *low, *AXES).join(lists, list(AXES)).select(
        "particle_id", "x", "y", "z", *low, F.inline("_answers"))
    return pairs.withColumns(brick_centre(size, stride_fraction)).drop(*low, *BRICK)


def raw_cells(df: DataFrame, grid: str | float = "grid_eff") -> DataFrame:
    """f0..f5 = floor(coord6 / grid) before the per-chunk shift."""
    g = F.col(grid) if isinstance(grid, str) else F.lit(float(grid))
    return df.withColumns({f: F.floor(F.col(c) / g) for f, c in zip(RAW_KEY, COORD6)})


def _spread(s: Column, s2: Column, n: Column) -> Column:
    mean = s / n
    return F.sqrt(F.greatest(s2 / n - mean * mean, F.lit(0.0)))


def cell_label(n_positive: Column, n: Column, rule: str = "any_positive") -> Column:
    """``majority`` (ties positive) or ``any_positive``."""
    if rule == "majority":
        return (n_positive * 2 >= n).cast("int")
    if rule == "any_positive":
        return (n_positive > 0).cast("int")
    raise ValueError(f"unknown label rule {rule!r}")


def sparse_cells(df: DataFrame, chunk: Sequence[str], features: Sequence[str], context: Sequence[str] = (),
                 label: str | None = "is_stream", rule: str = "any_positive", grid: str | float = "grid_eff",
                 origin: Sequence[str] | None = None, keep_raw: bool = False, parts: int | None = None) -> DataFrame:
    """Occupied 6-D cells per chunk with mean coordinates, mean features, count, context and label.

    Rows are aggregated on the unshifted cell key, so the data itself is
    shuffled once (after partial aggregation); the per-chunk minimum that shifts
    keys to zero is taken on the much smaller cell table.  ``parts``: partitions
    of the shuffles, for many rows (``order.task_parts``).
    """
    chunk = list(chunk)
    keyed = spread_rows(raw_cells(df, grid), parts, [*chunk, *RAW_KEY])
    n = F.count(F.lit(1))
    aggs = [n.alias("n")] + [F.avg(c).alias(c) for c in COORD6] + [F.avg(f).alias(f"mean_{f}") for f in features]
    if origin:
        aggs += [F.avg(p).alias(o) for o, p in zip(ORIGIN, origin)]
    if label:
        aggs.append(F.count_if(F.col(label) == 1).alias("n_pos"))
    sq = lambda c: F.sum(F.col(c) * F.col(c))
    wanted = set(context)
    if "voxel_sigma_v" in wanted:
        aggs += [(F.sum("vx") + F.sum("vy") + F.sum("vz")).alias("_sv"), (sq("vx") + sq("vy") + sq("vz")).alias("_sv2")]
    for name, col in (("voxel_sigma_vr", "vr"), ("voxel_sigma_speed", "speed"), ("voxel_sigma_lmag", "lmag")):
        if name in wanted:
            aggs += [F.sum(col).alias(f"_s_{col}"), sq(col).alias(f"_q_{col}")]
    if "voxel_l_align" in wanted:
        length = F.greatest(F.sqrt(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz")), F.lit(1e-8))
        aggs += [F.avg(F.col(c) / length).alias(f"_h_{c}") for c in ("lx", "ly", "lz")]
    cells = keyed.groupBy(*chunk, *RAW_KEY).agg(*aggs)

    nd = F.col("n").cast("double")
    extra = {
        "voxel_log_count": lambda: F.log1p(nd),
        "voxel_sigma_v": lambda: _spread(F.col("_sv"), F.col("_sv2"), nd * 3.0),
        "voxel_sigma_vr": lambda: _spread(F.col("_s_vr"), F.col("_q_vr"), nd),
        "voxel_sigma_speed": lambda: _spread(F.col("_s_speed"), F.col("_q_speed"), nd),
        "voxel_l_align": lambda: F.sqrt(F.col("_h_lx") ** 2 + F.col("_h_ly") ** 2 + F.col("_h_lz") ** 2),
        "voxel_sigma_lmag": lambda: _spread(F.col("_s_lmag"), F.col("_q_lmag"), nd),
    }
    unknown = wanted - set(extra)
    if unknown:
        raise ValueError(f"unknown context features {sorted(unknown)}")
    corner = cells.groupBy(*chunk).agg(*[F.min(f).alias(f"_m{f}") for f in RAW_KEY])
    cells = spread_rows(cells, parts, chunk).join(spread_rows(corner, parts, chunk), chunk) if chunk else cells.join(F.broadcast(corner))
    out = [*chunk, *[(F.col(f) - F.col(f"_m{f}")).alias(g) for f, g in zip(RAW_KEY, GRID)], "n", *COORD6]
    out += list(ORIGIN) if origin else []
    out += [f"mean_{f}" for f in features] + [extra[c]().alias(c) for c in context]
    if label:
        out += ["n_pos", cell_label(F.col("n_pos"), F.col("n"), rule).alias("label")]
    if keep_raw:
        out += list(RAW_KEY)
    return cells.select(*out)


def cell_to_particle(particles: DataFrame, cells: DataFrame, chunk: Sequence[str], values: Sequence[str],
                     grid: str | float = "grid_eff") -> DataFrame:
    """Send per-cell values back to the rows of each cell (``cells`` keeps its raw key)."""
    keys = [*chunk, *RAW_KEY]
    answers = small_side(cut_lineage(cells.select(*keys, *values)), SCORED_CELLS)
    return raw_cells(particles, grid).join(answers, keys).drop(*RAW_KEY)


def cell_hash(columns: Sequence[str] = GRID) -> Column:
    """Sum of axis * prime modulo 2**64, exact."""
    total = F.lit(0).cast("decimal(25,0)")
    for c, prime in zip(columns, HASH_PRIMES):
        total = (total + (F.col(c).cast("bigint") * F.lit(prime).cast("bigint")).cast("decimal(20,0)")).cast("decimal(25,0)")
    return F.pmod(total, F.lit("18446744073709551616").cast("decimal(25,0)"))


def cell_hash_cap(cells: DataFrame, chunk: Sequence[str], max_cells: int, parts: int | None = None) -> DataFrame:
    """Keep the ``max_cells`` cells of smallest label-independent hash in each chunk."""
    if set(RAW_KEY) & set(cells.columns):
        raise ValueError("a capped cell set cannot be mapped back to particles: drop the raw key first")
    hashed = cells.withColumn("_hash", cell_hash())
    # Hash values crowd at the low end of the range: bucket by leading digits of the logarithm.
    bucket = F.floor(F.log2(F.col("_hash").cast("double") + 1.0) * 128.0).cast("int")
    order = [F.col("_hash"), *[F.col(g) for g in GRID]]
    return rank_in_buckets(hashed, chunk, bucket, order, name="_r", take=F.lit(max_cells), parts=parts).drop("_hash", "_r")


POOL_REDUCERS = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}


def grid_pool(cells: DataFrame, chunk: Sequence[str], features: Sequence[str], stride: int = 2, reduce: str = "max",
              coords: Sequence[str] = COORD6) -> DataFrame:
    """Coarser cells: integer-divided grid, reduced features, mean coordinates."""
    if reduce not in POOL_REDUCERS:
        raise ValueError(f"reduce must be one of {sorted(POOL_REDUCERS)}")
    pooled = cells.withColumns({g: F.floor(F.col(g) / F.lit(int(stride))) for g in GRID})
    return pooled.groupBy(*chunk, *GRID).agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(c) for c in coords],
        *[POOL_REDUCERS[reduce](f).alias(f) for f in features])


def grid_unpool(cells: DataFrame, pooled: DataFrame, chunk: Sequence[str], features: Sequence[str], stride: int = 2) -> DataFrame:
    """Add each coarse cell's features to those of its member cells."""
    parent = {f"p{d}": F.floor(F.col(g) / F.lit(int(stride))) for d, g in enumerate(GRID)}
    coarse = pooled.select(*chunk, *[F.col(g).alias(f"p{d}") for d, g in enumerate(GRID)],
                           *[F.col(f).alias(f"_up_{f}") for f in features])
    joined = cells.withColumns(parent).join(coarse, [*chunk, *parent])
    return joined.withColumns({f: F.col(f) + F.col(f"_up_{f}") for f in features}).drop(
        *parent, *[f"_up_{f}" for f in features])
