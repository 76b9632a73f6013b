"""Point losses as one-pass aggregates over scored(y_true, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CLIP = 1e-7


def _clipped(prob: str = "prob") -> Column:
    return F.least(F.greatest(F.col(prob), F.lit(CLIP)), F.lit(1.0 - CLIP))


def cross_entropy(df: DataFrame, background_weight: float = 1.0, stream_weight: float = 1.0,
                  label_smoothing: float = 0.0) -> DataFrame:
    """Class-weighted cross-entropy with label smoothing, normalised by the weight of the targets.

    Smoothing spreads ``eps/2`` over both classes, each log term carrying its own class weight.
    """
    p = _clipped()
    pos = F.col("y_true") == 1
    log1, log0 = F.log(p), F.log(F.lit(1.0) - p)
    w0, w1 = float(background_weight), float(stream_weight)
    target = F.when(pos, -w1 * log1).otherwise(-w0 * log0)
    smooth = -(w1 * log1 + w0 * log0)
    term = (1.0 - label_smoothing) * target + (label_smoothing / 2.0) * smooth
    weight = F.when(pos, F.lit(w1)).otherwise(F.lit(w0))
    return df.agg((F.sum(term) / F.sum(weight)).alias("loss"))


def balanced_cross_entropy(df: DataFrame) -> DataFrame:
    """Cross-entropy with inverse-frequency class weights of the data itself."""
    p = _clipped()
    pos = F.col("y_true") == 1
    sums = df.agg(
        F.count_if(pos).alias("_np"), F.count_if(~pos).alias("_nn"),
        F.coalesce(F.sum(F.when(pos, -F.log(p))), F.lit(0.0)).alias("_sp"),
        F.coalesce(F.sum(F.when(~pos, -F.log(F.lit(1.0) - p))), F.lit(0.0)).alias("_sn"),
    )
    n1 = F.greatest(F.col("_np"), F.lit(1)).cast("double")
    n0 = F.greatest(F.col("_nn"), F.lit(1)).cast("double")
    raw1, raw0 = (n0 + n1) / (2.0 * n1), (n0 + n1) / (2.0 * n0)
    mean = F.greatest((raw0 + raw1) / 2.0, F.lit(1e-8))
    w1, w0 = raw1 / mean, raw0 / mean
    return sums.select(((w1 * F.col("_sp") + w0 * F.col("_sn")) / (w1 * F.col("_np") + w0 * F.col("_nn"))).alias("loss"))


def tanimoto(df: DataFrame, depth: int = 0) -> DataFrame:
    """Fractal Tanimoto loss of both classes with complement, averaged over depths 0..``depth``.

    With two classes the complement of one class is the other class, so the four
    similarities reduce to the two per-class sums.
    """
    p1, l1 = F.col("prob"), (F.col("y_true") == 1).cast("double")
    p0, l0 = F.lit(1.0) - p1, F.lit(1.0) - l1
    sums = df.agg(*[F.sum(a * b).alias(n) for n, a, b in (
        ("pl1", p1, l1), ("pp1", p1, p1), ("ll1", l1, l1), ("pl0", p0, l0), ("pp0", p0, p0), ("ll0", l0, l0))])

    def similarity(c: str) -> Column:
        pl, both = F.col(f"pl{c}"), F.col(f"pp{c}") + F.col(f"ll{c}")
        total = F.lit(0.0)
        for d in range(depth + 1):
            a = float(2 ** d)
            total = total + F.coalesce(F.try_divide(pl, F.lit(a) * both - F.lit(2.0 * a - 1.0) * pl), F.lit(0.0))
        return total / F.lit(float(depth + 1))

    return sums.select((F.lit(1.0) - (similarity("0") + similarity("1")) / 2.0).alias("loss"))


def hybrid(df: DataFrame, depth: int = 0, ce_weight: float = 0.5, tanimoto_weight: float = 0.5) -> DataFrame:
    ce = cross_entropy(df).select(F.col("loss").alias("_ce"))
    tn = tanimoto(df, depth).select(F.col("loss").alias("_tn"))
    return ce.join(F.broadcast(tn)).select((F.col("_ce") * ce_weight + F.col("_tn") * tanimoto_weight).alias("loss"))
