"""Registered queries: sources, cleaning, row-level features, sampling plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from phasefold.functions import phase
from phasefold.functions.hashing import MODULUS, hash32_sql
from phasefold.operators import augment, metrics, sampling
from phasefold.plans.fixtures import centres, p_patch, p_pred, p_vol, phase_sql, query, rd, rd_sql, read, rounded, with_views
from phasefold.plans.pipelines import phase_scales
from phasefold.operators.blending import threshold_masks
from phasefold.session import ensure_checkpoint_dir
from phasefold.sources import cleaning, matrix_files, sinks, splits

BASE = ("x", "y", "z", "vx", "vy", "vz")
DERIVED = ("r", "vr", "speed", "vt", "lx", "ly", "lz", "lmag")


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _h(key: str, seed: int) -> str:
    return hash32_sql(key, seed, "//")


# --- sources and cleaning ----------------------------------------------------


@query("scan_splits", with_views(
    "SELECT split, is_stream, CAST(count(*) AS BIGINT) AS n, CAST(sum(particle_id % 1000) AS BIGINT) AS id_sum FROM p_vol GROUP BY ALL", "p_vol"))
def scan_splits(spark, sf_dir):
    root = _folder(spark, "splits")
    splits.write_splits(p_vol(spark, sf_dir), root)
    rows = splits.scan_splits(spark, root, ("training", "validation"), layout="hive")
    return rows.groupBy("split", "is_stream").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("particle_id") % 1000).alias("id_sum"))


@query("scan_matrix_tree", with_views(
    "SELECT split, is_stream, CAST(count(*) AS BIGINT) AS n, CAST(sum(particle_id % 1000) AS BIGINT) AS id_sum, " + rd_sql("sum(floor(vr))") + " AS vr_sum FROM full14 WHERE x >= CAST(-100 AS DOUBLE) GROUP BY ALL",
    "p_vol", full14=phase_sql("p_vol")))
def scan_matrix_tree(spark, sf_dir):
    """A written tree of matrix files, read back with pruned columns and a condition at the source."""
    root = _folder(spark, "tree")
    matrix_files.write_tree(phase.phase_columns(p_vol(spark, sf_dir), 8), root)
    rows = matrix_files.read_tree(spark, root, ("training", "validation"), ["split", "is_stream", "particle_id", "vr"], [("x", ">=", -100.0)])
    return rows.groupBy("split", "is_stream").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("particle_id") % 1000).alias("id_sum"), rd(F.sum(F.floor("vr"))).alias("vr_sum"))


@query("file_sizes", "SELECT l_suppkey AS file_id, CAST(count(*) AS BIGINT) AS n_rows FROM lineitem GROUP BY ALL")
def file_sizes(spark, sf_dir):
    return splits.file_sizes(p_vol(spark, sf_dir))


@query("npy_source", with_views("SELECT particle_id, x, y, z, vx, vy, vz, r, vr, mass FROM full14", "p_vol", full14=phase_sql("p_vol")))
def npy_source(spark, sf_dir):
    matrix_files.register(spark)
    path = _folder(spark, "npy")
    rows = phase.phase_columns(p_vol(spark, sf_dir), 8).select(*BASE, "r", "vr", F.col("particle_id").cast("double").alias("id"), "mass")
    rows.write.format("npy_particles").mode("append").save(path)
    return spark.read.format("npy_particles").load(path).select("particle_id", *BASE, "r", "vr", "mass")


P_DUP = "SELECT particle_id, floor(x / 20) AS x, floor(y / 20) AS y, floor(z / 20) AS z, vx, vy, vz FROM p_vol"


def _p_dup(spark, sf_dir):
    lowered = {c: F.floor(F.col(c) / 20).cast("double") for c in ("x", "y", "z")}
    return p_vol(spark, sf_dir).withColumns(lowered).select("particle_id", *BASE)


@query("dedup_first", with_views(
    "SELECT particle_id, x, y, z, vx, vy, vz FROM p_dup QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY particle_id) = 1", "p_vol", p_dup=P_DUP))
def dedup_first(spark, sf_dir):
    return cleaning.dedup_first(_p_dup(spark, sf_dir))


@query("recentre", with_views(
    f"SELECT particle_id, {', '.join(f'{rd_sql(f'p.{c} * CAST(1.5 AS DOUBLE) - m.{c}', 5)} AS {c}' for c in 'xyz')} FROM p_vol p, "
    f"(SELECT {', '.join(f'avg({c} * CAST(1.5 AS DOUBLE)) AS {c}' for c in 'xyz')} FROM p_vol) m", "p_vol"))
def recentre(spark, sf_dir):
    out = cleaning.recentre(p_vol(spark, sf_dir).select("particle_id", *BASE), 1.5)
    return rounded(out, 5, ["x", "y", "z"]).select("particle_id", "x", "y", "z")


@query("default_columns", with_views("SELECT particle_id, CAST(1 AS DOUBLE) AS mass, x FROM p_vol", "p_vol"))
def default_columns(spark, sf_dir):
    raw = p_vol(spark, sf_dir).select(F.col("particle_id").alias("ParticleIDs"), "x")
    return cleaning.default_columns(raw)


@query("limit_particles", with_views("SELECT particle_id, x FROM p_vol ORDER BY particle_id LIMIT 1000", "p_vol"))
def limit_particles(spark, sf_dir):
    return cleaning.limit_particles(p_vol(spark, sf_dir).select("particle_id", "x"), 1000)


@query("threshold_masks", with_views(
    "SELECT particle_id, prob AS probability, " + ", ".join(
        f"prob >= CAST({t} AS DOUBLE) AS thr_{str(t).replace('.', 'p')}" for t in metrics.MASK_THRESHOLDS) + " FROM p_pred", "p_pred"))
def threshold_mask_columns(spark, sf_dir):
    rows = p_pred(spark, sf_dir).select("particle_id", F.col("prob").alias("probability"))
    return threshold_masks(rows, metrics.MASK_THRESHOLDS)


@query("prediction_sink", with_views(
    "SELECT 'tiled_blend' AS \"group\", CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (prob >= CAST(0.7 AS DOUBLE)) AS BIGINT) AS n_0p7 FROM p_pred",
    "p_pred"))
def prediction_sink(spark, sf_dir):
    path = _folder(spark, "predictions")
    rows = p_pred(spark, sf_dir).select("particle_id", F.col("prob").alias("probability"))
    sinks.write_predictions(rows, path, "tiled_blend", expected_rows=read(spark, sf_dir, "lineitem").count())
    stored = sinks.read_predictions(spark, path)
    return stored.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if("thr_0p7").alias("n_0p7"))


@query("stats_roundtrip", with_views(
    "SELECT " + ", ".join(f"{rd_sql(f'avg({c})', 4)} AS {c}_mean, {rd_sql(f'stddev_pop({c}) + 1e-6', 4)} AS {c}_std" for c in BASE) + " FROM p_vol", "p_vol"))
def stats_roundtrip(spark, sf_dir):
    stats = phase.feature_stats(p_vol(spark, sf_dir), BASE)
    path = _folder(spark, "stats")
    sinks.save_stats(stats, path)
    return rounded(sinks.load_stats(spark, path, stats), 4, stats.columns)


# --- row-level features ------------------------------------------------------


@query("phase_columns", with_views(
    "SELECT particle_id, " + ", ".join(f"{rd_sql(c, 5)} AS {c}" for c in DERIVED) + " FROM full14", "p_vol", full14=phase_sql("p_vol")))
def phase_columns(spark, sf_dir):
    out = phase.phase_columns(p_vol(spark, sf_dir))
    return rounded(out, 5, list(DERIVED)).select("particle_id", *DERIVED)


@query("feature_select", with_views(
    "SELECT particle_id, vx, vy, vz, " + ", ".join(f"{rd_sql(c, 5)} AS {c}" for c in ("r", "vr", "vt")) + " FROM full14", "p_vol", full14=phase_sql("p_vol")))
def feature_select(spark, sf_dir):
    out = phase.select_features(phase.phase_columns(p_vol(spark, sf_dir)), "phase_space_extended")
    return rounded(out, 5, ["r", "vr", "vt"])


def scales_sql(source: str, chunk: str) -> str:
    """Interpolated 0.9 quantiles of both norms per chunk, by rank."""
    frac = "(max(n - 1) * CAST(0.9 AS DOUBLE) - floor(max(n - 1) * CAST(0.9 AS DOUBLE)))"
    at = lambda c, rank: f"max(CASE WHEN rn_{c} = {rank} THEN {c} END)"
    low = lambda c: at(c, "floor((n - 1) * CAST(0.9 AS DOUBLE))")
    high = lambda c: at(c, "least(floor((n - 1) * CAST(0.9 AS DOUBLE)) + 1, n - 1)")
    pick = lambda c: (f"CASE WHEN {frac} = 0 OR {low(c)} = {high(c)} THEN {low(c)} ELSE (1 - {frac}) * {low(c)} + {frac} * {high(c)} END")
    return (
        f"SELECT {chunk}, greatest({pick('p')}, 1e-6) AS pos_scale, greatest({pick('v')}, 1e-6) AS vel_scale FROM ("
        f"SELECT {chunk}, p, v, count(*) OVER (PARTITION BY {chunk}) AS n, row_number() OVER (PARTITION BY {chunk} ORDER BY p) - 1 AS rn_p, "
        f"row_number() OVER (PARTITION BY {chunk} ORDER BY v) - 1 AS rn_v FROM ("
        f"SELECT {chunk}, sqrt(x * x + y * y + z * z) AS p, sqrt(vx * vx + vy * vy + vz * vz) AS v FROM {source})) GROUP BY {chunk}")


@query("dimensionless", with_views(
    f"SELECT particle_id, {rd_sql('r / pos_scale')} AS r, " + ", ".join(f"{rd_sql(f'{c} / vel_scale')} AS {c}" for c in ("vx", "vy", "vz", "vr", "speed", "vt"))
    + ", " + ", ".join(f"{rd_sql(f'{c} / greatest(pos_scale * vel_scale, 1e-12)')} AS {c}" for c in ("lx", "ly", "lz", "lmag"))
    + " FROM full14 JOIN scales USING (file_id)", "p_vol", full14=phase_sql("p_vol"), scales=scales_sql("p_vol", "file_id")))
def dimensionless(spark, sf_dir):
    rows = phase.phase_columns(p_vol(spark, sf_dir))
    names = phase.resolve_features("all")
    out = phase.dimensionless(rows.join(phase_scales(rows, ["file_id"]), "file_id"), names)
    return rounded(out, 6, names).select("particle_id", *names)


@query("phase_coord6", with_views(
    "SELECT particle_id, " + ", ".join(f"{rd_sql(f'({c} - CAST(10 AS DOUBLE)) / pos_scale')} AS c{i}" for i, c in enumerate("xyz"))
    + ", " + ", ".join(f"{rd_sql(f'{c} * CAST(0.05 AS DOUBLE) / pos_scale')} AS c{i + 3}" for i, c in enumerate(("vx", "vy", "vz")))
    + f", {rd_sql('greatest(CAST(4 AS DOUBLE) / pos_scale, 1e-4)')} AS grid_eff FROM p_vol JOIN scales USING (file_id)",
    "p_vol", scales=scales_sql("p_vol", "file_id")))
def phase_coord6(spark, sf_dir):
    rows = p_vol(spark, sf_dir)
    out = phase.phase_coord6(rows.join(phase_scales(rows, ["file_id"]), "file_id"), [F.lit(10.0)] * 3, 4.0)
    cols = [f"c{i}" for i in range(6)] + ["grid_eff"]
    return rounded(out, 6, cols).select("particle_id", *cols)


@query("standardise", with_views(
    "SELECT particle_id, " + ", ".join(f"{rd_sql(f'(p.{c} - m.{c}_m) / (m.{c}_s + 1e-6)')} AS {c}" for c in BASE) + " FROM p_vol p, (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in BASE) + " FROM p_vol) m", "p_vol"))
def standardise(spark, sf_dir):
    out = phase.standardise(p_vol(spark, sf_dir).select("particle_id", *BASE), BASE)
    return rounded(out, 6, list(BASE))


PRIOR_SQL = ("(q / (1 - q) * CAST({ratio!r} AS DOUBLE)) / (1 + q / (1 - q) * CAST({ratio!r} AS DOUBLE))".format(ratio=(0.07 / 0.93) / 1.0))


@query("prior_correct", with_views(
    f"SELECT particle_id, {rd_sql(PRIOR_SQL, 8)} AS prob FROM (SELECT particle_id, least(greatest(prob, 1e-8), 1 - 1e-8) AS q FROM p_pred)", "p_pred"))
def prior_correct(spark, sf_dir):
    return p_pred(spark, sf_dir).select("particle_id", rd(phase.prior_correct(F.col("prob")), 8).alias("prob"))


@query("margin_prob", with_views(
    f"SELECT particle_id, {rd_sql('vy / 100 - vx / 100')} AS margin, {rd_sql('1 / (1 + exp(-(vy / 100 - vx / 100)))')} AS prob FROM p_vol", "p_vol"))
def margin_prob(spark, sf_dir):
    margin, prob = phase.margin_prob(F.col("vx") / 100, F.col("vy") / 100)
    return p_vol(spark, sf_dir).select("particle_id", rd(margin).alias("margin"), rd(prob).alias("prob"))


# --- sampling plans ----------------------------------------------------------

SIZES = "SELECT file_id, CAST(count(*) AS BIGINT) AS n_rows FROM p_vol WHERE is_stream = 1 GROUP BY file_id"


def _sizes(spark, sf_dir):
    return splits.file_sizes(p_vol(spark, sf_dir).where("is_stream = 1"))


def allocation_sql(weight: str, cap: str, source: str = "sizes") -> str:
    """Floor shares plus one pass of leftovers; exact as long as no file ends up empty."""
    return (
        f"SELECT file_id, n_rows, CAST(cnt + CASE WHEN cnt < n_rows AND turn <= room THEN 1 ELSE 0 END AS BIGINT) AS n_take FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY cnt < n_rows ORDER BY raw - floor(raw) DESC, file_id) AS turn, "
        f"{cap} - sum(cnt) OVER () AS room FROM (SELECT *, least(floor(raw), n_rows) AS cnt FROM ("
        f"SELECT *, CAST({cap} AS DOUBLE) * (w / sum(w) OVER ()) AS raw FROM (SELECT *, {weight} AS w FROM {source}))))")


ALLOC_CAP = 10_007
MODE_WEIGHTS = {"proportional": "CAST(greatest(n_rows, 1) AS DOUBLE)", "sqrt": "sqrt(CAST(greatest(n_rows, 1) AS DOUBLE))", "equal": "CAST(1 AS DOUBLE)"}


def _alloc(mode: str):
    return lambda spark, sf_dir: sampling.allocate(_sizes(spark, sf_dir), ALLOC_CAP, {
        "proportional": "proportional", "sqrt": "sqrt_size", "equal": "equal_files"}[mode])


for _mode, _weight in MODE_WEIGHTS.items():
    query(f"alloc_{_mode}", with_views(allocation_sql(_weight, str(ALLOC_CAP)), "p_vol", sizes=SIZES))(_alloc(_mode))


@query("alloc_full_small", with_views(
    f"SELECT * FROM ({allocation_sql(MODE_WEIGHTS['proportional'], '100', 'large')}) UNION ALL "
    "SELECT file_id, n_rows, n_rows FROM ranked WHERE rn > 2", "p_vol", sizes=SIZES,
    ranked="SELECT *, row_number() OVER (ORDER BY n_rows DESC, file_id) AS rn FROM sizes", large="SELECT file_id, n_rows FROM ranked WHERE rn <= 2"))
def alloc_full_small(spark, sf_dir):
    return sampling.allocate_full_small(_sizes(spark, sf_dir), 100)


def take_sql(source: str, n: str, by: str, seed: int, key: str = "particle_id") -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {_h(key, seed)}, {key}) <= {n}"


@query("sample_per_file", with_views(
    f"SELECT file_id, particle_id FROM ({take_sql('joined', 'n_take', 'file_id', 3)})", "p_vol", sizes=SIZES,
    plan=allocation_sql(MODE_WEIGHTS["proportional"], str(ALLOC_CAP)),
    joined="SELECT p.*, n_take FROM p_vol p JOIN plan USING (file_id) WHERE is_stream = 1"))
def sample_per_file(spark, sf_dir):
    plan = sampling.allocate(_sizes(spark, sf_dir), ALLOC_CAP)
    rows = p_vol(spark, sf_dir).where("is_stream = 1")
    return sampling.sample_per_file(rows, plan, seed=3).select("file_id", "particle_id")


@query("split_files", with_views(
    f"SELECT file_id, CASE WHEN row_number() OVER (ORDER BY {_h('file_id', 42)}, file_id) <= greatest(round_even(count(*) OVER () * CAST(0.15 AS DOUBLE), 0), 1) "
    "THEN 'validation' ELSE 'training' END AS split FROM sizes", "p_vol", sizes=SIZES))
def split_files(spark, sf_dir):
    return sampling.split_files(_sizes(spark, sf_dir))


@query("split_rows", with_views(
    f"SELECT file_id, particle_id, CASE WHEN rn <= 20 THEN 'training' ELSE 'validation' END AS split FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {_h('particle_id', 42)}, particle_id) AS rn FROM p_vol) WHERE rn <= 30", "p_vol"))
def split_rows(spark, sf_dir):
    return sampling.split_rows(p_vol(spark, sf_dir), 20, 10, by=["file_id"]).select("file_id", "particle_id", "split")


@query("balanced_centres", with_views(
    f"SELECT file_id, particle_id, CAST(d AS BIGINT) AS draw FROM (SELECT s.*, row_number() OVER (PARTITION BY file_id ORDER BY {_h('particle_id', 0)}, particle_id) - 1 AS rn "
    "FROM p_vol s WHERE is_stream = 1) JOIN (SELECT *, 30011 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY file_id) - 1 < 30011 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM sizes) "
    "USING (file_id), LATERAL (SELECT unnest(range(rn, quota, n_rows)) AS d)", "p_vol", sizes=SIZES))
def balanced_centres(spark, sf_dir):
    return sampling.balanced_centres(p_vol(spark, sf_dir).where("is_stream = 1"), 30_011).select("file_id", "particle_id", "draw")


@query("augment_rotate")
def augment_rotate(spark, sf_dir):
    rows = p_vol(spark, sf_dir).withColumns({"cx": F.lit(10.0), "cy": F.lit(20.0), "cz": F.lit(30.0)})
    return augment.augment_chunk(rows, "file_id", seed=5, relative=True, scale=False)


_U = f"CAST({_h('file_id', 9)} AS DOUBLE) / CAST({MODULUS} AS DOUBLE)"
_SCALED = "SELECT particle_id, file_id, " + ", ".join(f"{c} * s AS {c}" for c in BASE) + f" FROM (SELECT *, pow(CAST(2 AS DOUBLE), -1 + 2 * ({_U})) AS s FROM p_vol)"


@query("augment_scale", with_views(
    "SELECT particle_id, " + ", ".join(f"{rd_sql(c, 4)} AS {c}" for c in (*BASE, "r", "vr", "speed", "vt")) + " FROM full14",
    "p_vol", scaled=_SCALED, full14=phase_sql("scaled")))
def augment_scale(spark, sf_dir):
    out = phase.phase_columns(augment.augment_scale(p_vol(spark, sf_dir), "file_id", 9))
    cols = [*BASE, "r", "vr", "speed", "vt"]
    return rounded(out, 4, cols).select("particle_id", *cols)


def eigen_sql(source: str, keys: str, floor: str = "1e-8") -> str:
    """Eigenvalues l_min <= l_mid <= l_max of (cxx, cyy, czz, cxy, cxz, cyz) by the trigonometric form."""
    return (
        f"SELECT *, greatest(q + 2 * pp * cos(phi + 2 * pi() / 3), {floor}) AS l_min, "
        f"greatest(3 * q - (q + 2 * pp * cos(phi)) - (q + 2 * pp * cos(phi + 2 * pi() / 3)), {floor}) AS l_mid, greatest(q + 2 * pp * cos(phi), {floor}) AS l_max FROM ("
        f"SELECT *, acos(greatest(-1.0, least(1.0, (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2))) / 3 AS phi FROM ("
        f"SELECT *, (cxx - q) / sp AS a, (cyy - q) / sp AS b, (czz - q) / sp AS c, cxy / sp AS d, cxz / sp AS e, cyz / sp AS f FROM ("
        f"SELECT *, CASE WHEN pp > 0 THEN pp ELSE 1 END AS sp FROM (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) "
        f"+ 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS pp FROM (SELECT *, (cxx + cyy + czz) / 3 AS q FROM {source})))))")


_COV = ("SELECT is_stream, CAST(count(*) AS BIGINT) AS sampled, " + ", ".join(
    f"covar_samp({a}, {b}) AS c{a}{b}" for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))) + " FROM p_vol GROUP BY is_stream")


@query("geometry_report", with_views(
    f"SELECT is_stream, sampled, {rd_sql('sqrt(l_max / l_min)')} AS axis_ratio, {rd_sql('l_min', 2)} AS l_min, {rd_sql('l_max', 2)} AS l_max FROM eig", "p_vol",
    cov=_COV, eig=eigen_sql("cov", "is_stream", "1e-12")))
def geometry_report(spark, sf_dir):
    out = sampling.geometry_report(p_vol(spark, sf_dir), by=["is_stream"])
    return rounded(out, {"axis_ratio": 6, "l_min": 2, "l_max": 2}).select("is_stream", "sampled", "axis_ratio", "l_min", "l_max")


@query("geometry_gate", with_views(
    f"SELECT {rd_sql('s')} AS stream_axis_ratio, {rd_sql('b')} AS background_axis_ratio, s >= 1.15 AND b <= 1.30 AS relative_rotation FROM ("
    "SELECT max(CASE WHEN is_stream = 1 THEN sqrt(l_max / l_min) END) AS s, max(CASE WHEN is_stream = 0 THEN sqrt(l_max / l_min) END) AS b FROM eig)", "p_vol",
    cov=_COV, eig=eigen_sql("cov", "is_stream", "1e-12")))
def geometry_gate(spark, sf_dir):
    return rounded(sampling.geometry_gate(p_vol(spark, sf_dir)), 6, ["stream_axis_ratio", "background_axis_ratio"])
