"""Snapshot cleaning: first-row deduplication, scaling, recentring, optional columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Accepted names of the id and mass columns, in order of preference.
ID_ALIASES = ("ParticleIDs", "ParticleID", "ParticleId", "particle_ids", "ids")
MASS_ALIASES = ("Mass", "Masses")

BASE_COLUMNS = ("x", "y", "z", "vx", "vy", "vz")


def require_columns(df: DataFrame, columns: Sequence[str] = BASE_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"particle table lacks columns {missing}")
    return df


def dedup_first(df: DataFrame, order: str = "particle_id", keys: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Keep the first row of every exact position.

    The rank limit is applied before the shuffle too, so a position shared by
    many rows sends one row per task.
    """
    first = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def recentre(df: DataFrame, pos_scale: float = 1.0, mode: str = "mean") -> DataFrame:
    """Scale positions and move their unweighted mean to the origin (``mode='none'`` only scales)."""
    scaled = df.withColumns({p: F.col(p) * F.lit(float(pos_scale)) for p in ("x", "y", "z")})
    if mode == "none":
        return scaled
    if mode != "mean":
        raise ValueError("mode must be 'mean' or 'none'")
    centre = scaled.agg(*[F.avg(p).alias(f"_{p}") for p in ("x", "y", "z")])
    return scaled.join(F.broadcast(centre)).withColumns({p: F.col(p) - F.col(f"_{p}") for p in ("x", "y", "z")}).drop("_x", "_y", "_z")


def default_columns(df: DataFrame, order: str = "row_index") -> DataFrame:
    """particle_id and mass under their own names: the first alias present, else row index and 1.0."""
    have = set(df.columns)
    id_name = next((n for n in ("particle_id", *ID_ALIASES) if n in have), order)
    mass_name = next((n for n in ("mass", *MASS_ALIASES) if n in have), None)
    mass = F.coalesce(F.col(mass_name).cast("double"), F.lit(1.0)) if mass_name else F.lit(1.0)
    out = df.withColumns({"particle_id": F.col(id_name).cast("bigint"), "mass": mass})
    return out.drop(*[n for n in (*ID_ALIASES, *MASS_ALIASES) if n in have and n not in ("particle_id", "mass")])


def limit_particles(df: DataFrame, n: int, order: str = "particle_id") -> DataFrame:
    """First n rows in id order; all rows when n is not positive."""
    return df.orderBy(order).limit(n) if n > 0 else df


def clean_snapshot(df: DataFrame, order: str = "particle_id", pos_scale: float = 1.0) -> DataFrame:
    return recentre(dedup_first(require_columns(df), order), pos_scale)
