"""Registered queries: density maps, smoothing, views and the component catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasefold.operators import maps
from phasefold.plans.fixtures import p_pred, quantile_sql, query, rd_sql, rounded, with_views

EXTENT = (-200.0, 200.0, -200.0, 200.0)
BINS = 1200
#: Smoothing of maps and of component masks, in pixels.
SIGMA, MASK_SIGMA = 1.6, 2.2
SELECTED = "prob >= CAST(0.9 AS DOUBLE)"


def _selected():
    return F.col("prob") >= F.lit(0.9)


def pixel_sql(a: str = "x", b: str = "y", closed: bool = True) -> str:
    axis = lambda c: f"floor(({c} + 200) / CAST(400 AS DOUBLE) * {BINS})"
    last = lambda c: f"CASE WHEN {c} = 200 THEN {BINS - 1} ELSE {axis(c)} END" if closed else axis(c)
    return f"CAST({last(a)} AS INTEGER) AS px, CAST({last(b)} AS INTEGER) AS py"


def histogram_sql(sums: str, a: str = "x", b: str = "y", where: str = "true") -> str:
    return f"SELECT {pixel_sql(a, b)}, {sums} FROM p_pred WHERE {a} BETWEEN -200 AND 200 AND {b} BETWEEN -200 AND 200 AND {where} GROUP BY ALL"


def smooth_sql(source: str, values: tuple[str, ...], sigma: float, truncate: float = 4.0) -> str:
    kernel = "(VALUES " + ", ".join(f"({d}, CAST({w!r} AS DOUBLE))" for d, w in maps.gaussian_kernel(sigma, truncate)) + ") k(d, w)"
    one = lambda inner, axis, other: (
        f"SELECT {other}, {axis} + d AS {axis}, {', '.join(f'sum({v} * w) AS {v}' for v in values)} FROM ({inner}), {kernel} WHERE {axis} + d BETWEEN 0 AND {BINS - 1} GROUP BY ALL")
    return one(one(f"SELECT * FROM {source}", "py", "px"), "px", "py")


@query("density_map", with_views(
    "SELECT * FROM (" + histogram_sql(f"CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({SELECTED}) AS BIGINT) AS n_selected, {rd_sql('sum(prob)')} AS weight", "x", "z") + ")", "p_pred"))
def density_map(spark, sf_dir):
    sums = {"n": F.lit(1), "n_selected": F.when(_selected(), 1).otherwise(0), "weight": F.col("prob")}
    return rounded(maps.density_map(p_pred(spark, sf_dir), EXTENT, "xz", BINS, sums), 6, ["weight"])


COUNTED = histogram_sql("CAST(count(*) AS DOUBLE) AS density")


@query("density_smooth", with_views(f"SELECT px, py, {rd_sql('density')} AS density FROM smoothed", "p_pred", counted=COUNTED, smoothed=smooth_sql("counted", ("density",), 1.6)))
def density_smooth(spark, sf_dir):
    return rounded(maps.density_smooth(p_pred(spark, sf_dir), EXTENT, "xy", BINS, 1.6), 6, ["density"])


BOTH = histogram_sql(f"CAST(count(*) AS DOUBLE) AS all_density, CAST(count(*) FILTER ({SELECTED}) AS DOUBLE) AS selected_density")


@query("density_products", with_views(
    f"SELECT px, py, {rd_sql('all_density')} AS all_density, {rd_sql('selected_density')} AS selected_density, {rd_sql('ln(1 + all_density)')} AS all_log, {rd_sql('ln(1 + selected_density)')} AS selected_log FROM smoothed",
    "p_pred", counted=BOTH, smoothed=smooth_sql("counted", ("all_density", "selected_density"), 1.6)))
def density_products(spark, sf_dir):
    out = maps.density_products(p_pred(spark, sf_dir), _selected(), EXTENT, "xy", BINS, 1.6)
    return rounded(out, 6, ["all_density", "selected_density", "all_log", "selected_log"])


@query("robust_max", with_views(f"SELECT {rd_sql('greatest(v, 1e-6)')} AS vmax FROM ({quantile_sql('(SELECT * FROM smoothed WHERE density > 0)', 'density', 0.997, 'v')})",
                                "p_pred", counted=COUNTED, smoothed=smooth_sql("counted", ("density",), 1.6)))
def robust_max(spark, sf_dir):
    return rounded(maps.robust_max(maps.density_smooth(p_pred(spark, sf_dir), EXTENT, "xy", BINS, 1.6), "density"), 6, ["vmax"])


def _view_sql(name: str, half: float) -> str:
    seen = f"abs(x) <= {half} AND abs(z) <= {half}"
    return (f"SELECT '{name}' AS \"view\", CAST(count(*) FILTER ({seen}) AS BIGINT) AS all_count, CAST(count(*) FILTER ({seen} AND {SELECTED}) AS BIGINT) AS selected_count, "
            f"{rd_sql(f'count(*) FILTER ({seen} AND {SELECTED}) / greatest(count(*) FILTER ({seen}), 1)')} AS selected_fraction, "
            f"{rd_sql(f'coalesce(avg(prob) FILTER ({seen} AND {SELECTED}), 0)')} AS mean_probability FROM p_pred")


@query("view_stats", with_views(" UNION ALL ".join(_view_sql(n, h) for n, h in maps.VIEWS.items()), "p_pred"))
def view_stats(spark, sf_dir):
    return rounded(maps.view_stats(p_pred(spark, sf_dir), _selected(), "xz"), 6, ["selected_fraction", "mean_probability"])


@query("mean_prob_map", with_views(
    f"SELECT px, py, {rd_sql('p / n')} AS mean_prob FROM smoothed", "p_pred", counted=histogram_sql("CAST(count(*) AS DOUBLE) AS n, sum(prob) AS p", "y", "z"),
    smoothed=smooth_sql("counted", ("n", "p"), 1.6, 3.0)))
def mean_prob_map(spark, sf_dir):
    return rounded(maps.mean_prob_map(p_pred(spark, sf_dir), EXTENT, "yz", BINS, 1.6), 6, ["mean_prob"])


@query("uncertainty_map", with_views(
    f"SELECT px, py, {rd_sql('sqrt(greatest(CASE WHEN n > 0 THEN v / n ELSE 0 END, 0))')} AS mean_sigma FROM smoothed", "p_pred",
    counted=histogram_sql(f"CAST(count(*) FILTER ({SELECTED}) AS DOUBLE) AS n, coalesce(sum(variance) FILTER ({SELECTED}), 0) AS v"), smoothed=smooth_sql("counted", ("n", "v"), 1.6)))
def uncertainty_map(spark, sf_dir):
    return rounded(maps.uncertainty_map(p_pred(spark, sf_dir), _selected(), EXTENT, "xy", BINS, 1.6), 6, ["mean_sigma"])


_OUTER = "prob >= CAST(0.99 AS DOUBLE) AND sqrt(x * x + y * y + z * z) > 25"


@query("adaptive_extent", with_views(
    f"SELECT CAST(n AS BIGINT) AS n_used, {', '.join(f'CASE WHEN n < 10 THEN {w} ELSE {rd_sql(e)} END AS {k}' for k, w, e in (('x0', -160, '(lx + hx) / 2 - half'), ('x1', 160, '(lx + hx) / 2 + half'), ('y0', -160, '(ly + hy) / 2 - half'), ('y1', 160, '(ly + hy) / 2 + half')))} "
    "FROM (SELECT *, greatest(greatest(hx - lx, hy - ly) * 0.5 * (1 + CAST(0.18 AS DOUBLE)), 35) AS half FROM (SELECT count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM p_pred, few, top "
    f"WHERE CASE WHEN m < 100 THEN prob >= cut ELSE {_OUTER} END))", "p_pred", few=f"SELECT count(*) AS m FROM p_pred WHERE {_OUTER}", top=quantile_sql("p_pred", "prob", 0.995)))
def adaptive_extent(spark, sf_dir):
    return rounded(maps.adaptive_extent(p_pred(spark, sf_dir), 0.99, "xy"), 6, ["x0", "x1", "y0", "y1"])


#: Rows of the component mask and catalogue: those that are stream rather than not.
LIKELY = "prob >= CAST(0.5 AS DOUBLE)"


def _likely():
    return F.col("prob") >= F.lit(0.5)


MASK_VIEWS = {
    "counted": histogram_sql("CAST(count(*) AS DOUBLE) AS density", where=LIKELY),
    "smoothed": smooth_sql("counted", ("density",), MASK_SIGMA),
    "mask": f"SELECT px, py, density, greatest(cut, 0.010) AS density_cut, py * {BINS} + px AS pixel FROM smoothed, ({quantile_sql('smoothed', 'density', 0.62)}) WHERE density >= greatest(cut, 0.010)",
    "labelled(px, py, label) USING KEY (px, py)": "SELECT px, py, pixel AS label FROM mask UNION SELECT n.px, n.py, min(l.label) FROM labelled l, "
        "(VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) s(dx, dy), recurring.labelled n WHERE n.px = l.px + dx AND n.py = l.py + dy AND l.label < n.label GROUP BY n.px, n.py",
}


def _labels(spark, sf_dir):
    mask = maps.component_mask(p_pred(spark, sf_dir), _likely(), EXTENT, "xy", BINS, MASK_SIGMA)
    return maps.components(mask, BINS)


@query("components", with_views(f"SELECT px, py, {rd_sql('density')} AS density, CAST(label AS BIGINT) AS label FROM mask JOIN labelled USING (px, py)", "p_pred", **MASK_VIEWS))
def components(spark, sf_dir):
    return rounded(_labels(spark, sf_dir).drop("density_cut"), 6, ["density"])


MIN_PIXELS, MIN_ROWS = 20, 70
CATALOGUE_VIEWS = {
    **MASK_VIEWS,
    "areas": "SELECT label, count(*) AS pixel_area, " + ", ".join(
        f"-200 + {f} / CAST({BINS} AS DOUBLE) * 400 AS bbox_{n}" for n, f in (("x_min", "min(px)"), ("x_max", "(max(px) + 1)"), ("y_min", "min(py)"), ("y_max", "(max(py) + 1)")))
             + f", max(density_cut) AS density_cut FROM mask JOIN labelled USING (px, py) GROUP BY label HAVING count(*) >= {MIN_PIXELS}",
    "hits": f"SELECT label, count(*) AS particle_count, avg(prob) AS mean_probability, avg(sqrt(greatest(variance, 0))) AS mean_probability_sigma, avg(x) AS centroid_x, avg(y) AS centroid_y FROM "
            f"(SELECT *, {pixel_sql(closed=False)} FROM p_pred WHERE {LIKELY} AND x BETWEEN -200 AND 200 AND y BETWEEN -200 AND 200) JOIN labelled USING (px, py) GROUP BY label HAVING count(*) >= {MIN_ROWS}",
    "found": "SELECT *, row_number() OVER (ORDER BY particle_count DESC, label) AS instance_id FROM hits JOIN areas USING (label)",
}
CATALOGUE = ("mean_probability", "mean_probability_sigma", "bbox_x_min", "bbox_x_max", "bbox_y_min", "bbox_y_max", "centroid_x", "centroid_y", "density_cut")


def _catalogue(spark, sf_dir):
    return maps.component_catalogue(p_pred(spark, sf_dir), _labels(spark, sf_dir), _likely(), EXTENT, "xy", BINS, MIN_PIXELS, MIN_ROWS)


@query("component_catalogue", with_views(
    "SELECT CAST(instance_id AS INTEGER) AS instance_id, CAST(particle_count AS BIGINT) AS particle_count, CAST(pixel_area AS BIGINT) AS pixel_area, "
    + ", ".join(f"{rd_sql(c)} AS {c}" for c in CATALOGUE) + " FROM found", "p_pred", **CATALOGUE_VIEWS))
def component_catalogue(spark, sf_dir):
    return rounded(_catalogue(spark, sf_dir), 6, list(CATALOGUE))


_HALF = "least(greatest(greatest(bbox_x_max - bbox_x_min, bbox_y_max - bbox_y_min) * 0.5 * (1 + CAST(0.32 AS DOUBLE)), 18), 170)"


@query("crop_extent", with_views(
    "SELECT CAST(instance_id AS INTEGER) AS instance_id, " + ", ".join(f"{rd_sql(e)} AS {k}" for k, e in (
        ("x0", f"greatest((bbox_x_min + bbox_x_max) / 2 - {_HALF}, -200)"), ("x1", f"least((bbox_x_min + bbox_x_max) / 2 + {_HALF}, 200)"),
        ("y0", f"greatest((bbox_y_min + bbox_y_max) / 2 - {_HALF}, -200)"), ("y1", f"least((bbox_y_min + bbox_y_max) / 2 + {_HALF}, 200)"))) + " FROM found", "p_pred", **CATALOGUE_VIEWS))
def crop_extent(spark, sf_dir):
    return rounded(maps.crop_extent(_catalogue(spark, sf_dir), EXTENT), 6, ["x0", "x1", "y0", "y1"])
