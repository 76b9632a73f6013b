"""Per-patch summary features over the arrays that neighbour searches return."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from phasefold.functions.linalg import with_eigenvalues
from phasefold.functions.phase import BASE, feature_stats, norm

CENTRE_FEATURES = ("centre_r", "centre_vr", "centre_speed", "centre_vt", "centre_lmag")
SUMMARY_11 = ("mean_dist", "max_dist", "sigma_v", "sigma_vr", "anis_ratio", "flatness", "l_align", "mean_speed_ratio",
              "mean_abs_dvr", "mean_vt", "lmag_ratio")
FEATURES_16 = CENTRE_FEATURES + tuple(f"patch_{s}" for s in SUMMARY_11)
SUMMARY_12 = ("mean_dist", "kth_dist") + SUMMARY_11[1:]
POINT_FEATURES_16 = tuple(f"pf{i:02d}" for i in range(16))
STATS_COLUMNS = BASE + ("r", "vr", "speed", "vt", "lx", "ly", "lz", "lmag")


def _phase(prefix: str, floor_radius: bool) -> dict[str, Column]:
    """Level-14 expressions over ``<prefix>x .. <prefix>vz``."""
    x, y, z, vx, vy, vz = (F.col(prefix + c) for c in BASE)
    r, speed = norm(x, y, z), norm(vx, vy, vz)
    safe = F.greatest(r, F.lit(1e-8)) if floor_radius else F.when(r == 0.0, F.lit(1e-8)).otherwise(r)
    vr = (x * vx + y * vy + z * vz) / safe
    lx, ly, lz = y * vz - z * vy, z * vx - x * vz, x * vy - y * vx
    return {"r": r, "vr": vr, "speed": speed, "vt": F.sqrt(F.greatest(speed * speed - vr * vr, F.lit(0.0))),
            "lx": lx, "ly": ly, "lz": lz, "lmag": norm(lx, ly, lz)}


def explode_patch(patches: DataFrame, id_col: str, floor_radius: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (centre, rank): base and derived columns of the centre (``q_``) and the neighbour (``n_``)."""
    q = patches.select(id_col, *keep, *[F.col(c).alias(f"q_{c}") for c in BASE], F.size("patch").alias("_len"),
                       F.posexplode("patch").alias("rank", "_e"))
    q = q.select(id_col, *keep, "_len", "rank", F.col("_e.id").alias("neigh_id"), *[f"q_{c}" for c in BASE],
                 *[F.col(f"_e.{c}").alias(f"n_{c}") for c in BASE])
    for side in ("q_", "n_"):
        q = q.withColumns({side + n: e for n, e in _phase(side, floor_radius).items()})
    return q.withColumns({f"d{c}": F.col(f"n_{c}") - F.col(f"q_{c}") for c in ("x", "y", "z")})


_AXES = {"xx": (0, 0), "yy": (1, 1), "zz": (2, 2), "xy": (0, 1), "xz": (0, 2), "yz": (1, 2)}
_MOMENTS = [*[f"centre_{c}" for c in ("r", "vr", "speed", "vt", "lmag")], "mean_dist", "max_dist", "kth_dist", "sigma_v", "sigma_vr",
            *[f"_c{n}" for n in _AXES], "l_align", "mean_speed_ratio", "mean_abs_dvr", "mean_vt", "lmag_ratio"]


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[:, 0] ** 2 + v[:, 1] ** 2 + v[:, 2] ** 2)


def _phase_rows(rows: np.ndarray, floor_radius: bool) -> tuple[np.ndarray, ...]:
    """r, vr, speed, vt and the angular momentum of (n, 6) base rows."""
    pos, vel = rows[:, :3], rows[:, 3:]
    r, speed = _length(pos), _length(vel)
    vr = (pos * vel).sum(axis=1) / (np.maximum(r, 1e-8) if floor_radius else np.where(r == 0.0, 1e-8, r))
    return r, vr, speed, np.sqrt(np.maximum(speed * speed - vr * vr, 0.0)), np.cross(pos, vel)


def _moments(centres: np.ndarray, rows: np.ndarray, sizes: np.ndarray, floor_radius: bool, align: str) -> list[np.ndarray]:
    """The columns ``_MOMENTS`` of patches whose rows follow each other, ``sizes`` rows each."""
    starts = np.cumsum(sizes) - sizes
    mean = lambda v: np.add.reduceat(v, starts) / sizes
    spread = lambda v: np.repeat(v, sizes)
    q_r, q_vr, q_speed, q_vt, q_mom = _phase_rows(centres, floor_radius)
    _, vr, speed, vt, mom = _phase_rows(rows, floor_radius)
    offset = rows[:, :3] - np.repeat(centres[:, :3], sizes, axis=0)
    dist, lmag, q_lmag = _length(offset), _length(mom), _length(q_mom)
    scale = np.maximum(lmag, 1e-6) if align == "floor" else lmag + 1e-6
    variance = lambda v: mean((v - spread(mean(v))) ** 2)
    v_mean = np.mean([mean(rows[:, i]) for i in (3, 4, 5)], axis=0)
    pooled = np.mean([mean((rows[:, i] - spread(v_mean)) ** 2) for i in (3, 4, 5)], axis=0)
    apart = [offset[:, i] - spread(mean(offset[:, i])) for i in range(3)]
    heading = _length(np.column_stack([mean(mom[:, i] / scale) for i in range(3)]))
    return [q_r, q_vr, q_speed, q_vt, q_lmag, mean(dist), np.maximum.reduceat(dist, starts), dist[starts + sizes // 2], np.sqrt(pooled), np.sqrt(variance(vr)),
            *[mean(apart[i] * apart[j]) for i, j in _AXES.values()], heading, mean(speed / spread(np.maximum(q_speed, 1e-6))),
            mean(np.abs(vr - spread(q_vr))), mean(vt), mean(lmag) / np.maximum(q_lmag, 1e-6)]


def _summaries(patches: DataFrame, id_col: str, keep: Sequence[str], floor_radius: bool, align: str) -> DataFrame:
    """All summaries of a patch from its own array, without a row per neighbour and without a shuffle; empty patches have none."""
    carried = list(dict.fromkeys([id_col, *keep]))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("patch")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            flat = lists.flatten()
            rows = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in BASE])
            centres = np.column_stack([batch.column(f"_{c}").to_numpy(zero_copy_only=False) for c in BASE])
            columns = _moments(centres, rows, sizes, floor_radius, align) if len(sizes) else [np.zeros(0)] * len(_MOMENTS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *[pa.array(c, pa.float64()) for c in columns]], names=[*carried, *_MOMENTS])

    kinds = dict(patches.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carried], *[f"{m} double" for m in _MOMENTS]])
    rows = patches.where(F.size("patch") > 0).select(*carried, *[F.col(c).cast("double").alias(f"_{c}") for c in BASE], "patch")
    out = with_eigenvalues(rows.mapInArrow(summarise, schema), [f"_c{n}" for n in _AXES])
    return out.withColumns({"anis_ratio": F.col("l_max") / F.col("l_min"), "flatness": F.col("l_mid") / F.col("l_max")})


def patch_features16(patches: DataFrame, id_col: str = "particle_id", keep: Sequence[str] = ()) -> DataFrame:
    """The 16 scalar features of the boosted-tree classifier: 5 of the centre, 11 of its patch."""
    out = _summaries(patches, id_col, keep, floor_radius=True, align="floor")
    return out.select(id_col, *keep, *CENTRE_FEATURES, *[F.col(s).alias(f"patch_{s}") for s in SUMMARY_11])


def patch_summary12(patches: DataFrame, id_col: str = "particle_id", keep: Sequence[str] = ()) -> DataFrame:
    """The 12 summaries of the patch classifier."""
    out = _summaries(patches, id_col, keep, floor_radius=False, align="add")
    return out.select(id_col, *keep, *SUMMARY_12)


def point_stats(df: DataFrame) -> DataFrame:
    """One row of means and stds that ``point_features16`` needs (level-14 columns)."""
    return feature_stats(df, STATS_COLUMNS)


def point_features16(patches: DataFrame, stats: DataFrame, id_col: str = "particle_id", keep: Sequence[str] = ()) -> DataFrame:
    """16 normalised features of every (centre, rank): relative position, velocity and momentum, scalars, distance, speed ratio."""
    edges = explode_patch(patches, id_col, keep=keep).join(F.broadcast(stats))  # one row
    rel = lambda c: (F.col(f"n_{c}") - F.col(f"q_{c}")) / F.col(f"{c}_std")
    std = lambda c: (F.col(f"n_{c}") - F.col(f"{c}_mean")) / F.col(f"{c}_std")
    cols = [rel(c) for c in BASE] + [std(c) for c in ("r", "vr", "speed", "vt")] + [rel(c) for c in ("lx", "ly", "lz")]
    cols += [std("lmag"), norm(*[rel(c) for c in ("x", "y", "z")]), F.col("n_speed") / F.greatest(F.col("q_speed"), F.lit(1e-6))]
    return edges.select(id_col, *keep, "rank", "neigh_id", *[c.alias(n) for c, n in zip(cols, POINT_FEATURES_16)])
