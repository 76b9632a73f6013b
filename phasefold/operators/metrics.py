"""Selection rules and binary-classification metrics over scored(y_true, prob)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from phasefold.functions.order import exact_quantiles, prefix_sums

# Default sweep and output-mask thresholds.
SWEEP_THRESHOLDS = (0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.975, 0.99)
MASK_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)

METRICS = ("acc", "precision", "recall", "specificity", "balanced_acc", "f1", "dice", "iou", "bg_iou", "miou", "mcc",
           "pred_pos_frac", "true_pos_frac")


def select_threshold(df: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    return df.withColumn("selected", F.col(prob) >= F.lit(float(threshold)))


def select_top_fraction(df: DataFrame, fraction: float = 0.07, prob: str = "prob") -> DataFrame:
    """Keep-flag ``prob >= quantile(1 - fraction)``; all ties at the cut are selected."""
    fraction = min(max(float(fraction), 1e-6), 1.0)
    cut = exact_quantiles(df, prob, [1.0 - fraction]).select(F.col("q0").alias("cut"))
    return df.join(F.broadcast(cut)).withColumn("selected", F.col(prob) >= F.col("cut"))


def confusion(df: DataFrame, by: Sequence[str] = (), y: str = "y_true", pred: Column | None = None) -> DataFrame:
    """tp, tn, fp, fn per group in one pass."""
    pred = F.col("prob") >= 0.5 if pred is None else pred
    pos = F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count_if(pos & pred).alias("tp"), F.count_if(~pos & ~pred).alias("tn"),
        F.count_if(~pos & pred).alias("fp"), F.count_if(pos & ~pred).alias("fn"),
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Every scalar metric of a table holding tp, tn, fp, fn; denominators are floored at 1."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda num, den: num / F.greatest(den, F.lit(1.0))
    total = tp + tn + fp + fn
    out = counts.withColumns({
        "acc": ratio(tp + tn, total), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp), "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn),
        "bg_iou": ratio(tn, tn + fp + fn), "pred_pos_frac": ratio(tp + fp, total), "true_pos_frac": ratio(tp + fn, total),
        # The four factors are rooted apart: their product leaves the exact range of a double.
        "mcc": (tp * tn - fp * fn) / F.greatest(
            F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn), F.lit(1.0)),
    })
    return out.withColumns({
        "dice": F.col("f1"),
        "balanced_acc": (F.col("recall") + F.col("specificity")) * 0.5,
        "miou": (F.col("iou") + F.col("bg_iou")) * 0.5,
    })


def binary_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(confusion(df, by, pred=F.col("prob") >= F.lit(float(threshold))))


def sweep_counts(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts per threshold from a single scan.

    Each row adds one to the band between neighbouring thresholds; the counts
    per threshold are sums over the bounded band table, so the input is not
    multiplied by the number of thresholds.
    """
    cuts = sorted({float(t) for t in thresholds})
    band = F.lit(0)
    for t in cuts:
        band = band + (F.col("prob") >= F.lit(t)).cast("int")
    bands = df.groupBy(*by, band.alias("_band")).agg(
        F.count_if(F.col("y_true") == 1).alias("_p"), F.count_if(F.col("y_true") != 1).alias("_n"))
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("_lvl")) for i, t in enumerate(cuts)]))
    spread = bands.withColumn("_t", levels).select(*by, "_p", "_n", "_band", "_t.*")
    over = F.col("_band") >= F.col("_lvl")
    cnt = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("bigint")
    return spread.groupBy(*by, "threshold").agg(
        cnt(over, "_p").alias("tp"), cnt(~over, "_n").alias("tn"), cnt(over, "_n").alias("fp"), cnt(~over, "_p").alias("fn"))


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(sweep_counts(df, thresholds, by))


def threshold_name(threshold: float) -> str:
    return "thr_" + str(float(threshold)).replace(".", "p")


def metrics_wide(df: DataFrame, prefix: str = "val", thresholds: Sequence[float] = SWEEP_THRESHOLDS,
                 metrics: Sequence[str] = METRICS, loss: DataFrame | None = None) -> DataFrame:
    """One epoch row: metrics at 0.5 plus ``prefix_thrXpY_metric`` for every threshold."""
    swept = threshold_sweep(df, thresholds)
    fields = [*metrics, "tp", "tn", "fp", "fn"]
    base = 0.5 if 0.5 in [float(t) for t in thresholds] else float(thresholds[0])
    pick = lambda t, f: F.max(F.when(F.col("threshold") == F.lit(float(t)), F.col(f)))
    out = [pick(base, f).alias(f"{prefix}_{f}") for f in fields]
    for t in thresholds:
        key = threshold_name(t)[4:]
        out += [pick(t, f).alias(f"{prefix}_thr{key}_{f}") for f in fields if f not in ("bg_iou", "miou")]
    row = swept.agg(*out)
    if loss is None:
        return row
    return F.broadcast(loss.select(F.col("loss").alias(f"{prefix}_loss"))).join(row)


def score_groups(df: DataFrame, by: Sequence[str] = (), prob: str = "prob", y: str = "y_true") -> DataFrame:
    """Distinct scores with their positives and negatives (ties folded, map-side combined)."""
    return df.groupBy(*by, F.col(prob).alias("prob")).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) != 1).alias("_neg"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties averaged; NaN when a class is missing."""
    cum = prefix_sums(score_groups(df, by), "prob", {"_cn": "_neg"}, by=by)
    wins = F.col("_pos").cast("double") * (F.col("_cn") - F.col("_neg") / 2.0)
    out = cum.groupBy(*by).agg(F.sum(wins).alias("_w"), F.sum("_pos").cast("double").alias("_p"), F.sum("_neg").cast("double").alias("_n"))
    area = F.coalesce(F.try_divide(F.col("_w"), F.col("_p") * F.col("_n")), F.lit(float("nan")))
    return out.select(*by, area.alias("auc"))


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision, from the highest score down."""
    cum = prefix_sums(score_groups(df, by), "prob", {"_cp": "_pos", "_cn": "_neg"}, descending=True, by=by)
    step = F.col("_pos").cast("double") * F.col("_cp") / (F.col("_cp") + F.col("_cn"))
    out = cum.groupBy(*by).agg(F.sum(step).alias("_s"), F.sum("_pos").cast("double").alias("_p"))
    return out.select(*by, F.coalesce(F.try_divide(F.col("_s"), F.col("_p")), F.lit(float("nan"))).alias("auprc"))


def class_report(df: DataFrame, threshold: float = 0.5, names: Mapping[int, str] | None = None) -> DataFrame:
    """Precision, recall, f1 and support per class, macro and weighted averages."""
    names = names or {0: "background", 1: "stream"}
    counts = confusion(df, pred=F.col("prob") >= F.lit(float(threshold)))
    row = lambda label, tp, fp, fn: F.struct(
        F.lit(label).alias("label"), F.col(tp).cast("double").alias("tp"), F.col(fp).cast("double").alias("fp"),
        F.col(fn).cast("double").alias("fn"))
    classes = counts.select(F.inline(F.array(row(names[0], "tn", "fn", "fp"), row(names[1], "tp", "fp", "fn"))))
    ratio = lambda num, den: num / F.greatest(den, F.lit(1.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_class = classes.select("label", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                               ratio(2.0 * tp, 2.0 * tp + fp + fn).alias("f1"), (tp + fn).cast("bigint").alias("support"))
    fields = ("precision", "recall", "f1")
    weight = F.col("support")
    macro = per_class.agg(*[F.avg(f).alias(f) for f in fields], F.sum("support").alias("support"))
    weighted = per_class.agg(*[(F.sum(F.col(f) * weight) / F.greatest(F.sum(weight), F.lit(1))).alias(f) for f in fields],
                             F.sum("support").alias("support"))
    cols = ["label", *fields, "support"]
    return per_class.unionByName(macro.withColumn("label", F.lit("macro avg")).select(*cols)).unionByName(
        weighted.withColumn("label", F.lit("weighted avg")).select(*cols))


def score_percentiles(df: DataFrame, percents: Sequence[float] = (50, 80, 90, 95, 99, 99.5, 99.9), prob: str = "prob") -> DataFrame:
    """Percentile report of the scores, one row per percentile."""
    wide = exact_quantiles(df, prob, [p / 100.0 for p in percents])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("percentile"), F.col(f"q{i}").alias("value")) for i, p in enumerate(percents)])))
