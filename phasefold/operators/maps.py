"""Projected density maps, their smoothing, and the component catalogue, as sparse pixel tables (px, py, ...)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from phasefold.functions.order import exact_quantiles
from phasefold.session import cut_lineage, small_side

PROJECTIONS = {"xy": ("x", "y"), "xz": ("x", "z"), "yz": ("y", "z")}

# Half-widths of the standard views.
VIEWS = {"full_800kpc": 400.0, "inner_400kpc": 200.0, "central_160kpc": 80.0, "central_80kpc": 40.0}

Extent = tuple[float, float, float, float]


def _axes(projection: str) -> tuple[str, str]:
    if projection not in PROJECTIONS:
        raise ValueError(f"unknown projection {projection!r}")
    return PROJECTIONS[projection]


def in_view(extent: Extent, projection: str) -> Column:
    """Inclusive view mask."""
    a, b = (F.col(c) for c in _axes(projection))
    return (a >= extent[0]) & (a <= extent[1]) & (b >= extent[2]) & (b <= extent[3])


def _pixel(value: Column, low: float, high: float, bins: int) -> Column:
    return F.floor((value - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(bins)).cast("int")


def density_map(df: DataFrame, extent: Extent, projection: str = "xy", bins: int = 1200, sums: dict[str, Column] | None = None) -> DataFrame:
    """Histogram of a projection over a fixed extent, last edge inclusive.

    ``sums`` names the pixel columns; each is a summed expression (default: the
    row count), so counts, masked counts and weights share one pass.
    """
    a, b = _axes(projection)
    sums = sums or {"n": F.lit(1)}
    last = F.lit(bins - 1)
    px = F.when(F.col(a) == F.lit(float(extent[1])), last).otherwise(_pixel(F.col(a), extent[0], extent[1], bins))
    py = F.when(F.col(b) == F.lit(float(extent[3])), last).otherwise(_pixel(F.col(b), extent[2], extent[3], bins))
    return df.where(in_view(extent, projection)).groupBy(px.alias("px"), py.alias("py")).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()])


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    if sigma <= 0:
        return [(0, 1.0)]
    radius = max(1, int(round(truncate * sigma)))
    raw = [(d, math.exp(-0.5 * (d / sigma) ** 2)) for d in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(d, w / total) for d, w in raw]


def smooth(pixels: DataFrame, values: Sequence[str], sigma: float, bins: int, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian with zero padding: two passes of spread-and-sum over occupied pixels."""
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in gaussian_kernel(sigma, truncate)])
    out = pixels
    for axis, other in (("py", "px"), ("px", "py")):
        spread = out.withColumn("_k", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("_k.d"))
        out = spread.where((F.col(axis) >= 0) & (F.col(axis) < bins)).groupBy(axis, other).agg(
            *[F.sum(F.col(v) * F.col("_k.w")).alias(v) for v in values])
    return out.select("px", "py", *values)


def density_smooth(df: DataFrame, extent: Extent, projection: str, bins: int, sigma: float, truncate: float = 4.0) -> DataFrame:
    return smooth(density_map(df, extent, projection, bins, {"density": F.lit(1.0)}), ["density"], sigma, bins, truncate)


def robust_max(pixels: DataFrame, value: str, q: float = 0.997) -> DataFrame:
    """Quantile of the positive finite pixel values, floored at 1e-6; 1 when there are none."""
    v = F.col(value)
    good = pixels.where((v > 0) & ~F.isnan(v) & (v < F.lit(float("inf"))))
    return exact_quantiles(good, value, [q]).agg(F.coalesce(F.greatest(F.max("q0"), F.lit(1e-6)), F.lit(1.0)).alias("vmax"))


def density_products(df: DataFrame, selected: Column, extent: Extent, projection: str, bins: int, sigma: float) -> DataFrame:
    """Smoothed all and selected densities with their log1p; pixels without a row hold zero."""
    sums = {"all_density": F.lit(1.0), "selected_density": F.when(selected, 1.0).otherwise(0.0)}
    pixels = smooth(density_map(df, extent, projection, bins, sums), list(sums), sigma, bins)
    return pixels.withColumns({"all_log": F.log1p("all_density"), "selected_log": F.log1p("selected_density")})


def view_stats(df: DataFrame, selected: Column, projection: str = "xy", views: dict[str, float] | None = None, prob: str = "prob") -> DataFrame:
    """Counts, selected share and mean selected probability of every view, in one pass."""
    views = views or VIEWS
    extents = {n: (-h, h, -h, h) for n, h in views.items()}
    aggs = []
    for n, e in extents.items():
        seen = in_view(e, projection)
        aggs += [F.count_if(seen).alias(f"{n}_n"), F.count_if(seen & selected).alias(f"{n}_s"),
                 F.avg(F.when(seen & selected, F.col(prob))).alias(f"{n}_p")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("view"), F.col(f"{n}_n").alias("all_count"), F.col(f"{n}_s").alias("selected_count"),
        (F.col(f"{n}_s").cast("double") / F.greatest(F.col(f"{n}_n"), F.lit(1))).alias("selected_fraction"),
        F.coalesce(F.col(f"{n}_p"), F.lit(0.0)).alias("mean_probability")) for n in views])))


def mean_prob_map(df: DataFrame, extent: Extent, projection: str, bins: int, sigma: float, prob: str = "prob", truncate: float = 3.0) -> DataFrame:
    """Smoothed probability sum over smoothed count."""
    pixels = smooth(density_map(df, extent, projection, bins, {"_n": F.lit(1.0), "_p": F.col(prob)}), ["_n", "_p"], sigma, bins, truncate)
    return pixels.select("px", "py", F.when(F.col("_n") > 0, F.try_divide(F.col("_p"), F.col("_n"))).otherwise(0.0).alias("mean_prob"))


def uncertainty_map(df: DataFrame, selected: Column, extent: Extent, projection: str, bins: int, sigma: float, variance: str = "variance") -> DataFrame:
    """Root of the smoothed mean variance of the selected rows."""
    sums = {"_n": F.when(selected, 1.0).otherwise(0.0), "_v": F.when(selected, F.col(variance)).otherwise(0.0)}
    pixels = smooth(density_map(df, extent, projection, bins, sums), list(sums), sigma, bins)
    mean = F.when(F.col("_n") > 0, F.try_divide(F.col("_v"), F.col("_n"))).otherwise(0.0)
    return pixels.select("px", "py", F.sqrt(F.greatest(mean, F.lit(0.0))).alias("mean_sigma"))


def adaptive_extent(df: DataFrame, threshold: float, projection: str = "xy", min_half_width: float = 35.0, pad_fraction: float = 0.18,
                    prob: str = "prob") -> DataFrame:
    """Padded square around the selected outer rows; falls back to the top 0.5 %, then to +-160."""
    a, b = (F.col(c) for c in _axes(projection))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cut = exact_quantiles(df, prob, [0.995]).select(F.col("q0").alias("_cut"))
    rules = {"s": (F.col(prob) >= threshold) & (r > 25.0), "t": F.col(prob) >= F.col("_cut")}
    aggs = []
    for n, cond in rules.items():
        aggs.append(F.count_if(cond).alias(f"{n}_n"))
        aggs += [f(F.when(cond, c)).alias(f"{n}_{k}") for c, ks in ((a, ("lo0", "hi0")), (b, ("lo1", "hi1"))) for f, k in zip((F.min, F.max), ks)]
    one = df.join(F.broadcast(cut)).agg(*aggs)
    few = F.col("s_n") < 100
    one = one.select(F.when(few, F.col("t_n")).otherwise(F.col("s_n")).alias("n_used"), *[
        F.when(few, F.col(f"t_{k}")).otherwise(F.col(f"s_{k}")).alias(k) for k in ("lo0", "hi0", "lo1", "hi1")])
    half = F.greatest(F.greatest(F.col("hi0") - F.col("lo0"), F.col("hi1") - F.col("lo1")) * 0.5 * (1.0 + pad_fraction), F.lit(min_half_width))
    mid0, mid1 = (F.col("lo0") + F.col("hi0")) * 0.5, (F.col("lo1") + F.col("hi1")) * 0.5
    wide = F.col("n_used") < 10
    return one.select(
        "n_used", F.when(wide, -160.0).otherwise(mid0 - half).alias("x0"), F.when(wide, 160.0).otherwise(mid0 + half).alias("x1"),
        F.when(wide, -160.0).otherwise(mid1 - half).alias("y0"), F.when(wide, 160.0).otherwise(mid1 + half).alias("y1"))


def component_mask(df: DataFrame, selected: Column, extent: Extent, projection: str, bins: int, sigma: float = 2.2,
                   quantile: float = 0.62, absolute: float = 0.010) -> DataFrame:
    """Pixels (px, py, density, density_cut) of the smoothed selected density at or above the adaptive cut."""
    pixels = density_smooth(df.where(selected), extent, projection, bins, sigma).where("density > 0")
    cut = exact_quantiles(pixels, "density", [quantile]).select(F.greatest(F.col("q0"), F.lit(absolute)).alias("density_cut"))
    return pixels.join(F.broadcast(cut)).where(F.col("density") >= F.col("density_cut"))


def _join_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over items 0..n-1 and links (a, b): the smallest item of each item's component.

    All links hook their larger root under the smaller one at once, then paths are halved to the roots.
    """
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above


def _label_block(bins: int) -> Callable[[pa.Table], pa.Table]:
    """Pixels of one raster block with the smallest raster index of their component inside the block."""

    def label(block: pa.Table) -> pa.Table:
        px, py = (block.column(c).to_numpy().astype(np.int64) for c in ("px", "py"))
        pixel = py * bins + px
        order = np.argsort(pixel)
        px, py, pixel = px[order], py[order], pixel[order]
        links = []
        for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
            inside = (px + dx >= px.min()) & (px + dx <= px.max())
            to = pixel + dy * bins + dx
            at = np.minimum(np.searchsorted(pixel, to), len(pixel) - 1)
            hit = inside & (pixel[at] == to)
            links.append(np.column_stack([np.flatnonzero(hit), at[hit]]))
        links = np.concatenate(links)
        root = _join_labels(len(pixel), links[:, 0], links[:, 1])
        return pa.table({"px": pa.array(px.astype(np.int32)), "py": pa.array(py.astype(np.int32)), "root": pa.array(pixel[root])})

    return label


def components(mask: DataFrame, bins: int, block: int = 256) -> DataFrame:
    """Label 8-connected pixels with the smallest raster index of their component.

    Pixels are labelled inside raster blocks of ``block`` x ``block`` first, by union-find in the task that holds the
    block.  What is left is a graph of block components that touch across block borders; on it every
    round hooks whole components: each label takes the smallest label beside it and follows the hooks to their end, so
    at most half of the labels that have neighbours are left, however long components wind.  Lineage is cut by a
    reliable checkpoint each round.
    """
    tile = [F.floor(F.col(c) / block).alias(f"_{c}") for c in ("px", "py")]
    found = mask.select(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), *tile).groupBy("_px", "_py").applyInArrow(_label_block(bins), "px int, py int, root bigint")
    found = cut_lineage(found)
    edge = lambda c: (F.pmod(c, F.lit(block)) == 0) | (F.pmod(c, F.lit(block)) == block - 1)
    border = found.where(edge(F.col("px")) | edge(F.col("py")))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    near = border.select(F.col("root").alias("label"), F.explode(steps).alias("_s"), "px", "py").select(
        "label", (F.col("px") + F.col("_s.dx")).alias("px"), (F.col("py") + F.col("_s.dy")).alias("py"))
    edges = near.join(border.select("px", "py", F.col("root").alias("next")), ["px", "py"]).where("label <> next").select("label", "next").distinct()
    edges = cut_lineage(edges)
    tops = cut_lineage(edges.select(F.col("label").alias("root")).distinct().withColumn("label", F.col("root")))
    while not edges.isEmpty():
        hooks = cut_lineage(edges.groupBy("label").agg(F.min("next").alias("up")).where("up < label"))
        moving = True
        while moving:  # hooks lead to smaller labels only: pointer doubling ends at the local minima
            far = hooks.select(F.col("label").alias("up"), F.col("up").alias("above"))
            hooks = cut_lineage(hooks.join(far, "up", "left").select("label", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
            moving = not hooks.where("moved").isEmpty()
            hooks = hooks.drop("moved")
        to = lambda name: hooks.select(F.col("label").alias(name), F.col("up").alias(f"{name}_up"))
        tops = cut_lineage(tops.join(to("label"), "label", "left").select("root", F.coalesce("label_up", "label").alias("label")))
        edges = edges.join(to("label"), "label", "left").join(to("next"), "next", "left").select(
            F.coalesce("label_up", "label").alias("label"), F.coalesce("next_up", "next").alias("next")).where("label <> next").distinct()
        edges = cut_lineage(edges)
    labelled = found.join(small_side(tops), "root", "left").select("px", "py", F.coalesce("label", "root").alias("label"))
    return mask.join(labelled, ["px", "py"])


def component_catalogue(df: DataFrame, labels: DataFrame, selected: Column, extent: Extent, projection: str, bins: int,
                        min_pixels: int = 20, min_particles: int = 70, max_components: int | None = None,
                        prob: str = "prob", variance: str = "variance") -> DataFrame:
    """Components by selected rows, the largest first, with mean probability, mean sigma, box, centroid and cut."""
    a, b = _axes(projection)
    width, height = extent[1] - extent[0], extent[3] - extent[2]
    side = lambda low, c, span: F.lit(float(low)) + c.cast("double") / F.lit(bins) * F.lit(float(span))
    areas = labels.groupBy("label").agg(
        F.count(F.lit(1)).alias("pixel_area"), side(extent[0], F.min("px"), width).alias("bbox_x_min"),
        side(extent[0], F.max("px") + 1, width).alias("bbox_x_max"), side(extent[2], F.min("py"), height).alias("bbox_y_min"),
        side(extent[2], F.max("py") + 1, height).alias("bbox_y_max"), F.max("density_cut").alias("density_cut"),
    ).where(F.col("pixel_area") >= min_pixels)
    rows = df.where(selected & in_view(extent, projection)).select(
        _pixel(F.col(a), extent[0], extent[1], bins).alias("px"), _pixel(F.col(b), extent[2], extent[3], bins).alias("py"),
        F.col(a).alias("_a"), F.col(b).alias("_b"), prob, variance)
    # Rows fold to pixels first: the label join then works on at most bins**2 rows.
    folded = rows.groupBy("px", "py").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(prob).alias("_p"), F.sum(F.sqrt(F.greatest(F.col(variance), F.lit(0.0)))).alias("_s"),
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    stats = folded.join(labels.select("px", "py", "label"), ["px", "py"]).groupBy("label").agg(
        F.sum("_n").alias("particle_count"), (F.sum("_p") / F.sum("_n")).alias("mean_probability"),
        (F.sum("_s") / F.sum("_n")).alias("mean_probability_sigma"), (F.sum("_a") / F.sum("_n")).alias("centroid_x"),
        (F.sum("_b") / F.sum("_n")).alias("centroid_y")).where(F.col("particle_count") >= min_particles)
    # At most bins**2 / min_pixels components reach this window.
    ranked = stats.join(areas, "label").withColumn(
        "instance_id", F.row_number().over(Window.orderBy(F.col("particle_count").desc(), "label")))
    kept = ranked if max_components is None else ranked.where(F.col("instance_id") <= max_components)
    return kept.drop("label")


def crop_extent(catalogue: DataFrame, extent: Extent, pad_fraction: float = 0.32, min_half_width: float = 18.0, max_half_width: float = 170.0) -> DataFrame:
    """Padded square crop per component, clipped to the parent extent."""
    x0, x1, y0, y1 = (F.col(f"bbox_{s}") for s in ("x_min", "x_max", "y_min", "y_max"))
    half = F.least(F.greatest(F.greatest(x1 - x0, y1 - y0) * 0.5 * (1.0 + pad_fraction), F.lit(min_half_width)), F.lit(max_half_width))
    cx, cy = (x0 + x1) * 0.5, (y0 + y1) * 0.5
    return catalogue.select("instance_id", F.greatest(cx - half, F.lit(float(extent[0]))).alias("x0"), F.least(cx + half, F.lit(float(extent[1]))).alias("x1"),
                            F.greatest(cy - half, F.lit(float(extent[2]))).alias("y0"), F.least(cy + half, F.lit(float(extent[3]))).alias("y1"))
