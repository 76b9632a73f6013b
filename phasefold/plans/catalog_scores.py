"""Registered queries: selection, metrics, losses, learning, run logs and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from phasefold.operators import flagship, learning, losses, metrics, neighbours, patches, runlogs, voxels
from phasefold.plans import pipelines
from phasefold.plans.catalog_rows import BASE
from phasefold.plans.catalog_space import GRID_SIZE
from phasefold.plans.fixtures import p_patch, p_vol, quantile_sql, query, rd, rd_sql, read, rounded, scored, with_views
from phasefold.session import cut_lineage, ensure_checkpoint_dir
from phasefold.functions import phase
from phasefold.streaming import incremental

# --- selection and metrics ---------------------------------------------------

PRED = with_views


@query("select_threshold", with_views("SELECT particle_id, prob >= CAST(0.7 AS DOUBLE) AS selected FROM p_pred", "p_pred"))
def select_threshold(spark, sf_dir):
    from phasefold.plans.fixtures import p_pred

    return metrics.select_threshold(p_pred(spark, sf_dir).select("particle_id", "prob"), 0.7).drop("prob")


@query("select_top_fraction", with_views(
    f"SELECT particle_id, {rd_sql('cut')} AS cut, prob >= cut AS selected FROM p_pred, ({quantile_sql('p_pred', 'prob', 1.0 - 0.07)})", "p_pred"))
def select_top_fraction(spark, sf_dir):
    from phasefold.plans.fixtures import p_pred

    out = metrics.select_top_fraction(p_pred(spark, sf_dir).select("particle_id", "prob"))
    return out.select("particle_id", rd("cut").alias("cut"), "selected")


@query("score_percentiles", with_views(" UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS percentile, {rd_sql('v')} AS value FROM ({quantile_sql('scored', 'prob', p / 100.0, 'v')})" for p in (50, 80, 90, 95, 99, 99.5, 99.9)), "scored"))
def score_percentiles(spark, sf_dir):
    return rounded(metrics.score_percentiles(scored(spark, sf_dir)), 6, ["value"])


COUNTS = ("CAST(count(*) FILTER (y_true = 1 AND prob >= {t}) AS BIGINT) AS tp, CAST(count(*) FILTER (y_true = 0 AND prob < {t}) AS BIGINT) AS tn, "
          "CAST(count(*) FILTER (y_true = 0 AND prob >= {t}) AS BIGINT) AS fp, CAST(count(*) FILTER (y_true = 1 AND prob < {t}) AS BIGINT) AS fn")
T = "CAST({} AS DOUBLE)"
FORMULAS = {
    "acc": "(tp + tn) / greatest(tp + tn + fp + fn, 1)", "precision": "tp / greatest(tp + fp, 1)", "recall": "tp / greatest(tp + fn, 1)",
    "specificity": "tn / greatest(tn + fp, 1)", "balanced_acc": "(tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2",
    "f1": "2 * tp / greatest(2 * tp + fp + fn, 1)", "dice": "2 * tp / greatest(2 * tp + fp + fn, 1)", "iou": "tp / greatest(tp + fp + fn, 1)",
    "bg_iou": "tn / greatest(tn + fp + fn, 1)", "miou": "(tp / greatest(tp + fp + fn, 1) + tn / greatest(tn + fp + fn, 1)) / 2",
    "mcc": "(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / greatest(sqrt(CAST(tp + fp AS DOUBLE)) * sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 1)",
    "pred_pos_frac": "(tp + fp) / greatest(tp + tn + fp + fn, 1)", "true_pos_frac": "(tp + fn) / greatest(tp + tn + fp + fn, 1)",
}
METRIC_COLS = ", ".join(f"{rd_sql(e)} AS {n}" for n, e in FORMULAS.items())
SWEEP = " UNION ALL ".join(f"SELECT {T.format(t)} AS threshold, {COUNTS.format(t=T.format(t))} FROM scored" for t in metrics.SWEEP_THRESHOLDS)


def _rounded_metrics(df):
    return rounded(df, 6, list(FORMULAS))


@query("binary_metrics", with_views(f"SELECT tp, tn, fp, fn, {METRIC_COLS} FROM (SELECT {COUNTS.format(t=T.format(0.5))} FROM scored)", "scored"))
def binary_metrics(spark, sf_dir):
    return _rounded_metrics(metrics.binary_metrics(scored(spark, sf_dir)))


@query("threshold_sweep", with_views(f"SELECT threshold, tp, tn, fp, fn, {METRIC_COLS} FROM ({SWEEP})", "scored"))
def threshold_sweep(spark, sf_dir):
    return _rounded_metrics(metrics.threshold_sweep(scored(spark, sf_dir)))


def _wide_sql() -> str:
    fields = [*metrics.METRICS, "tp", "tn", "fp", "fn"]
    pick = lambda t, f: f"max(CASE WHEN threshold = {T.format(t)} THEN {f} END)"
    cols = [f"{pick(0.5, f)} AS val_{f}" for f in fields]
    for t in metrics.SWEEP_THRESHOLDS:
        cols += [f"{pick(t, f)} AS val_{metrics.threshold_name(t).replace('_', '')}_{f}" for f in fields if f not in ("bg_iou", "miou")]
    return with_views(f"SELECT {', '.join(cols)} FROM (SELECT threshold, tp, tn, fp, fn, {METRIC_COLS} FROM ({SWEEP}))", "scored")


@query("metrics_wide", _wide_sql())
def metrics_wide(spark, sf_dir):
    out = metrics.metrics_wide(scored(spark, sf_dir))
    return rounded(out, 6, [c for c in out.columns if not c.endswith(("_tp", "_tn", "_fp", "_fn"))])


GROUPED = "SELECT prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM scored GROUP BY prob"


@query("roc_auc", with_views(
    f"SELECT {rd_sql('sum(pos * (below + neg / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))')} AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM grouped)",
    "scored", grouped=GROUPED))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir)), 6, ["auc"])


@query("avg_precision", with_views(
    f"SELECT {rd_sql('sum(pos * (cp / (cp + cn))) / sum(pos)')} AS auprc FROM (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS cp, CAST(sum(neg) OVER w AS DOUBLE) AS cn FROM grouped WINDOW w AS (ORDER BY prob DESC))",
    "scored", grouped=GROUPED))
def avg_precision(spark, sf_dir):
    return rounded(metrics.average_precision(scored(spark, sf_dir)), 6, ["auprc"])


_CLASSES = ("SELECT 'background' AS label, tn / greatest(tn + fn, 1) AS precision, tn / greatest(tn + fp, 1) AS recall, 2 * tn / greatest(2 * tn + fn + fp, 1) AS f1, tn + fp AS support FROM c "
            "UNION ALL SELECT 'stream', tp / greatest(tp + fp, 1), tp / greatest(tp + fn, 1), 2 * tp / greatest(2 * tp + fp + fn, 1), tp + fn FROM c")
_F3 = ("precision", "recall", "f1")


@query("class_report", with_views(
    f"SELECT label, {', '.join(f'{rd_sql(f)} AS {f}' for f in _F3)}, CAST(support AS BIGINT) AS support FROM (SELECT * FROM k "
    f"UNION ALL SELECT 'macro avg', {', '.join(f'avg({f})' for f in _F3)}, sum(support) FROM k UNION ALL SELECT 'weighted avg', {', '.join(f'sum({f} * support) / sum(support)' for f in _F3)}, sum(support) FROM k)",
    "scored", c=f"SELECT {COUNTS.format(t=T.format(0.5))} FROM scored", k=_CLASSES))
def class_report(spark, sf_dir):
    return rounded(metrics.class_report(scored(spark, sf_dir)), 6, list(_F3))


# --- losses ------------------------------------------------------------------

_P = "least(greatest(prob, 1e-7), 1 - 1e-7)"
CLIPPED = f"SELECT y_true, prob, {_P} AS p, ln({_P}) AS l1, ln(1 - {_P}) AS l0 FROM scored"
CE = "sum(CASE WHEN y_true = 1 THEN -l1 ELSE -l0 END) / count(*)"


@query("loss_ce", with_views(
    f"SELECT {rd_sql('sum(0.98 * CASE WHEN y_true = 1 THEN -l1 ELSE -2 * l0 END + 0.01 * -(l1 + 2 * l0)) / sum(CASE WHEN y_true = 1 THEN 1 ELSE 2 END)')} AS loss FROM clipped", "scored", clipped=CLIPPED))
def loss_ce(spark, sf_dir):
    return rounded(losses.cross_entropy(scored(spark, sf_dir), background_weight=2.0, label_smoothing=0.02), 6, ["loss"])


@query("loss_balanced_ce", with_views(
    f"SELECT {rd_sql('(w1 * s1 + w0 * s0) / (w1 * n1 + w0 * n0)')} AS loss FROM (SELECT *, r1 / ((r1 + r0) / 2) AS w1, r0 / ((r1 + r0) / 2) AS w0 FROM (SELECT *, (n1 + n0) / (2 * n1) AS r1, (n1 + n0) / (2 * n0) AS r0 FROM ("
    "SELECT CAST(count(*) FILTER (y_true = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y_true = 0) AS DOUBLE) AS n0, sum(-l1) FILTER (y_true = 1) AS s1, sum(-l0) FILTER (y_true = 0) AS s0 FROM clipped)))",
    "scored", clipped=CLIPPED))
def loss_balanced_ce(spark, sf_dir):
    return rounded(losses.balanced_cross_entropy(scored(spark, sf_dir)), 6, ["loss"])


SETS = "SELECT " + ", ".join(f"sum({a} * {b}) AS {n}" for n, a, b in (
    ("pl1", "prob", "y_true"), ("pp1", "prob", "prob"), ("ll1", "y_true", "y_true"), ("pl0", "(1 - prob)", "(1 - y_true)"), ("pp0", "(1 - prob)", "(1 - prob)"), ("ll0", "(1 - y_true)", "(1 - y_true)"))) + " FROM scored"


def _tanimoto(depth: int) -> str:
    sim = lambda c: " + ".join(f"pl{c} / ({2 ** d} * (pp{c} + ll{c}) - {2 ** (d + 1) - 1} * pl{c})" for d in range(depth + 1))
    return f"1 - (({sim('0')}) + ({sim('1')})) / {2 * (depth + 1)}"


@query("loss_tanimoto", with_views(f"SELECT {rd_sql(_tanimoto(3))} AS loss FROM sets", "scored", sets=SETS))
def loss_tanimoto(spark, sf_dir):
    return rounded(losses.tanimoto(scored(spark, sf_dir), depth=3), 6, ["loss"])


@query("loss_hybrid", with_views(f"SELECT {rd_sql(f'ce / 2 + ({_tanimoto(0)}) / 2')} AS loss FROM sets, (SELECT {CE} AS ce FROM clipped)", "scored", sets=SETS, clipped=CLIPPED))
def loss_hybrid(spark, sf_dir):
    return rounded(losses.hybrid(scored(spark, sf_dir)), 6, ["loss"])


# --- learning ----------------------------------------------------------------

PATCH_K = 40  # the smallest file of the fixture holds 44 rows
HELD_OUT = "particle_id % 5 = 0"
_TRAINED: dict[tuple[str, str], tuple[str, str]] = {}


def _flagship(spark, sf_dir):
    """(feature table, path of the saved flagship): trained once an application, all defaults, early stop on a fifth of the rows."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        where = f"{ensure_checkpoint_dir(spark)}/flagship-{uuid.uuid4().hex}"
        pipelines.feature_set_table(p_patch(spark, sf_dir), PATCH_K).write.parquet(f"{where}/features")
        table = spark.read.parquet(f"{where}/features")
        model = flagship.fit_flagship(table.where(f"NOT ({HELD_OUT})"), table.where(HELD_OUT))
        flagship.save_flagship(model, f"{where}/model")
        _TRAINED[key] = (f"{where}/features", f"{where}/model")
    features, path = _TRAINED[key]
    return spark.read.parquet(features), path


def _trees(path):
    """The assembler and the trees of a saved flagship."""
    return PipelineModel(stages=flagship.load_flagship(path).stages[1:3])


@query("gbt_train_score")
def gbt_train_score(spark, sf_dir):
    """Early-stopped training with a validation split by id, scored on all rows."""
    table, path = _flagship(spark, sf_dir)
    return learning.score(_trees(path), table).select("particle_id", "is_stream", "prob", "margin")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    _, path = _flagship(spark, sf_dir)
    return learning.feature_importance(_trees(path), patches.FEATURES_16)


@query("gbt_eval_history")
def gbt_eval_history(spark, sf_dir):
    """Training and validation rows side by side, round by round."""
    table, path = _flagship(spark, sf_dir)
    return learning.gbt_eval_history(_trees(path), {"train": table.where(f"NOT ({HELD_OUT})"), "val": table.where(HELD_OUT)})


@query("gbt_infer")
def gbt_infer(spark, sf_dir):
    """The saved flagship, loaded into a new object, on a raw snapshot."""
    _, path = _flagship(spark, sf_dir)
    return flagship.load_flagship(path, patches.FEATURES_16).transform(p_patch(spark, sf_dir))


@query("flagship_saved")
def flagship_saved(spark, sf_dir):
    """Saved and reloaded once more: its margins beside those that SQL finds by walking the node table, and its metadata."""
    table, path = _flagship(spark, sf_dir)
    again = f"{ensure_checkpoint_dir(spark)}/flagship-{uuid.uuid4().hex}"
    flagship.save_flagship(flagship.load_flagship(path), again)
    model = flagship.load_flagship(again, patches.FEATURES_16, k=flagship.K)
    known = flagship.metadata_of(model)
    trees = PipelineModel(stages=model.stages[1:3])
    by_nodes = learning.node_margins(table, learning.node_table(trees), patches.FEATURES_16)
    scored = learning.score(trees, by_nodes)
    return scored.select("particle_id", rd("margin").alias("margin"), rd("node_margin").alias("node_margin"), F.lit(known["k"]).alias("k"),
                         F.lit(known["best_iteration"]).alias("best_iteration"), F.lit(len(known["feature_order"])).alias("n_features"))


@query("cell_classify")
def cell_classify(spark, sf_dir):
    """Boosted trees on sparse cells, mapped back to particles."""
    rows = phase.phase_columns(p_vol(spark, sf_dir))
    ready, cells = pipelines.cell_pipeline(rows, ["split"], [F.lit(0.0)] * 3, grid_size=GRID_SIZE, keep_raw=True)
    cells = cut_lineage(cells)
    names = [c for c in cells.columns if c.startswith(("mean_", "voxel_"))]
    model = learning.train_gbt(cells.where("split = 'training'"), names, label="label")
    scored_cells = learning.score(model, cells)
    return voxels.cell_to_particle(ready.select("particle_id", "split", *voxels.COORD6, "grid_eff"), scored_cells, ["split"], ["prob"]).select("particle_id", "split", "prob")


@query("mlp_patch")
def mlp_patch(spark, sf_dir):
    spaced = neighbours.space_columns(p_patch(spark, sf_dir), "xyzv")
    found = neighbours.knn_patches(spaced, 48, neighbours.space_dims("xyzv"), payload=list(BASE))
    table = cut_lineage(patches.patch_summary12(found, keep=["is_stream"]))
    ready = phase.standardise(table, patches.SUMMARY_12)
    model = learning.train_mlp(ready, patches.SUMMARY_12)
    return model.transform(ready).select("particle_id", "is_stream", F.col("prediction").cast("int").alias("pred_label"))


def _toy_model():
    """A stand-in for a loaded network: a fixed linear logit."""
    weights = np.array([0.01, -0.02, 0.005])

    def predict(batch: np.ndarray) -> np.ndarray:
        logit = batch.astype(np.float64) @ weights
        return 1.0 / (1.0 + np.exp(-logit))

    return predict


@query("batch_score", with_views(
    f"SELECT particle_id, {rd_sql('1 / (1 + exp(-(y * CAST(0.01 AS DOUBLE) - z * CAST(0.02 AS DOUBLE) + vx * CAST(0.005 AS DOUBLE))))')} AS prob FROM p_vol", "p_vol"))
def batch_score(spark, sf_dir):
    scorer = learning.batch_scorer(_toy_model, 3)
    return p_vol(spark, sf_dir).select("particle_id", rd(scorer([F.col("y"), F.col("z"), F.col("vx")])).alias("prob"))


# --- run logs ----------------------------------------------------------------

THRESHOLDS = {"0p5": 100000, "0p7": 150000, "0p9": 200000}
LOG_ROWS = (
    "SELECT o_orderpriority AS log_file, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS mtime, CAST(year(o_orderdate) - 1993 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS epoch, "
    "avg(o_totalprice) / CAST(500000 AS DOUBLE) AS val_mcc, "
    + ", ".join(f"avg(CASE WHEN o_totalprice > {v} AND o_totalprice < {v} + 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS val_thr{k}_iou" for k, v in THRESHOLDS.items())
    + " FROM orders GROUP BY o_orderpriority, year(o_orderdate)")
LOG_METRICS = ["val_mcc", *[f"val_thr{k}_iou" for k in THRESHOLDS]]
LOG_OUT = "log_file, mtime, epoch, " + ", ".join(f"{rd_sql(m)} AS {m}" for m in LOG_METRICS)


def _logs(spark, sf_dir):
    """One row per (order priority, order year), standing for log file and epoch."""
    name = f"orders_{uuid.uuid4().hex}"
    read(spark, sf_dir, "orders").createOrReplaceTempView(name)
    return spark.sql(LOG_ROWS.replace("FROM orders", f"FROM {name}"))


def _log_folder(spark, sf_dir) -> str:
    """Write the log rows as pipe-delimited files, one per log, with a truncated last line."""
    path = f"{ensure_checkpoint_dir(spark)}/logs-{uuid.uuid4().hex}"
    header = "|".join(["epoch", *LOG_METRICS])
    line = F.concat_ws("|", F.col("epoch").cast("string"), *[F.col(m).cast("string") for m in LOG_METRICS])
    lines = F.transform(F.sort_array(F.collect_list(F.struct("epoch", line.alias("line")))), lambda e: e["line"])
    text = F.concat(F.lit(header + "\n"), F.array_join(lines, "\n"), F.lit("\n9|0.1"))
    _logs(spark, sf_dir).groupBy(F.col("mtime").alias("log")).agg(text.alias("value")).write.partitionBy("log").text(path)
    return path


_CELLS_SQL = "SELECT CAST(mtime AS INTEGER) AS log, epoch, key, {v} AS value FROM (SELECT * FROM (SELECT mtime, epoch, {cols} FROM logs) UNPIVOT (raw FOR key IN ({cols})))".format(
    v=rd_sql("raw"), cols=", ".join(LOG_METRICS))


def _cell_rows(cells):
    """(log, epoch, key, value) of parsed log cells."""
    log = F.regexp_extract("log_file", r"log=(\d+)", 1).cast("int").alias("log")
    epoch = cells.where("key = 'epoch'").select("log_file", "line", F.col("value").cast("int").alias("epoch"))
    return cells.where("key <> 'epoch'").join(epoch, ["log_file", "line"]).select(log, "epoch", "key", rd("value").alias("value"))


@query("read_logs", with_views(_CELLS_SQL, logs=LOG_ROWS))
def read_logs(spark, sf_dir):
    return _cell_rows(runlogs.read_logs(spark, _log_folder(spark, sf_dir)))


@query("log_concat", with_views(f"SELECT {LOG_OUT} FROM logs", logs=LOG_ROWS))
def log_concat(spark, sf_dir):
    return rounded(runlogs.log_concat(_logs(spark, sf_dir)), 6, LOG_METRICS)


@query("log_latest", with_views(f"SELECT {LOG_OUT} FROM logs QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY mtime DESC) = 1", logs=LOG_ROWS))
def log_latest(spark, sf_dir):
    return rounded(runlogs.log_latest(_logs(spark, sf_dir)), 6, LOG_METRICS)


@query("log_lineage", with_views(
    f"SELECT {LOG_OUT} FROM logs, (SELECT min(epoch) AS first FROM logs WHERE mtime = (SELECT max(mtime) FROM logs)) WHERE mtime = (SELECT max(mtime) FROM logs) OR epoch < first "
    "QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY mtime DESC) = 1", logs=LOG_ROWS))
def log_lineage(spark, sf_dir):
    return rounded(runlogs.log_lineage(_logs(spark, sf_dir)), 6, LOG_METRICS)


@query("best_swept", with_views(
    f"SELECT log_file, epoch, {rd_sql('max(v)')} AS best_value, arg_max(t, v) AS best_threshold FROM (" + " UNION ALL ".join(
        f"SELECT log_file, epoch, val_thr{k}_iou AS v, CAST({k.replace('p', '.')} AS DOUBLE) AS t FROM logs" for k in THRESHOLDS) + ") GROUP BY ALL", logs=LOG_ROWS))
def best_swept(spark, sf_dir):
    long = runlogs.swept_long(_logs(spark, sf_dir), ["log_file", "epoch"])
    return rounded(runlogs.best_swept(long, ["log_file", "epoch"], "val", "iou"), 6, ["best_value"])


@query("best_epoch", with_views(f"SELECT {LOG_OUT} FROM latest ORDER BY latest.val_mcc DESC, epoch LIMIT 1", logs=LOG_ROWS,
                                latest="SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY mtime DESC) = 1"))
def best_epoch(spark, sf_dir):
    return rounded(runlogs.best_epoch(runlogs.log_latest(_logs(spark, sf_dir)), "val_mcc"), 6, LOG_METRICS)


@query("last_epochs", with_views(f"SELECT {LOG_OUT} FROM latest ORDER BY epoch DESC LIMIT 3", logs=LOG_ROWS,
                                 latest="SELECT * FROM logs QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY mtime DESC) = 1"))
def last_epochs(spark, sf_dir):
    return rounded(runlogs.last_epochs(runlogs.log_latest(_logs(spark, sf_dir)), 3), 6, LOG_METRICS)


# --- streams -----------------------------------------------------------------

EVENT_SCORES = {"y_true": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END", "prob": "least(value / CAST(500 AS DOUBLE), CAST(1 AS DOUBLE))"}
EVENTS = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVENT_SCORES.items()) + " FROM events"


@query("stream_metrics", with_views(f"SELECT threshold, tp, tn, fp, fn, {METRIC_COLS} FROM ({SWEEP})", scored=EVENTS))
def stream_metrics(spark, sf_dir):
    """The events arrive as several files, one micro-batch each."""
    events, path = read(spark, sf_dir, "events"), f"{ensure_checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    events.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _rounded_metrics(incremental.stream_metrics(stream.selectExpr(*[f"{e} AS {n}" for n, e in EVENT_SCORES.items()])))


@query("stream_logs", with_views(_CELLS_SQL, logs=LOG_ROWS))
def stream_logs(spark, sf_dir):
    return _cell_rows(incremental.stream_logs(spark, _log_folder(spark, sf_dir)))
