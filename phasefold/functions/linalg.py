"""Eigenvalues of symmetric 3x3 matrices as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def with_eigenvalues(df: DataFrame, cov: Sequence[str], out: Sequence[str] = ("l_min", "l_mid", "l_max"),
                     floor: float = 1e-8) -> DataFrame:
    """Ascending eigenvalues of (xx, yy, zz, xy, xz, yz), floored.

    Trigonometric closed form: shift by the mean eigenvalue, scale, and read the
    three roots off one arc cosine.
    """
    xx, yy, zz, xy, xz, yz = (F.col(c) for c in cov)
    df = df.withColumn("_q", (xx + yy + zz) / 3.0)
    q = F.col("_q")
    off = xy * xy + xz * xz + yz * yz
    df = df.withColumn("_p", F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off) / 6.0))
    p = F.when(F.col("_p") > 0.0, F.col("_p")).otherwise(F.lit(1.0))
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2.0))) / 3.0)
    df = df.withColumns({
        "_hi": q + 2.0 * F.col("_p") * F.cos(F.col("_phi")),
        "_lo": q + 2.0 * F.col("_p") * F.cos(F.col("_phi") + 2.0 * math.pi / 3.0),
    })
    mid = 3.0 * q - F.col("_hi") - F.col("_lo")
    values = (F.col("_lo"), mid, F.col("_hi"))
    return df.withColumns({n: F.greatest(v, F.lit(floor)) for n, v in zip(out, values)}).drop("_q", "_p", "_phi", "_hi", "_lo")
