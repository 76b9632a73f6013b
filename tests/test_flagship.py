import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from phasefold.operators import flagship, learning, metrics, patches
from phasefold.plans import pipelines


@pytest.fixture(scope="module")
def snapshot(spark, cloud):
    return spark.createDataFrame(cloud.drop_duplicates(["x", "y", "z"]).head(300))


@pytest.fixture(scope="module")
def table(snapshot):
    return pipelines.patch_feature_table(snapshot, 12, keep=["is_stream"]).cache()


@pytest.fixture(scope="module")
def fitted(table):
    held = F.col("particle_id") % 4 == 0
    return flagship.fit_flagship(table.where(~held), table.where(held), k=12, maxIter=6, maxDepth=3, selection={"top_fraction": 0.1})


def test_saved_flagship_gives_the_same_outputs(spark, snapshot, fitted, tmp_path):
    flagship.save_flagship(fitted, str(tmp_path / "m"))
    loaded = flagship.load_flagship(str(tmp_path / "m"), k=12)
    assert flagship.metadata_of(loaded) == flagship.metadata_of(fitted)
    known = flagship.metadata_of(loaded)
    assert known["k"] == 12 and known["feature_order"] == list(patches.FEATURES_16) and len(known["top_features_by_gain"]) == 10
    assert {"mcc", "auc", "auprc"} <= set(known["final_val_metrics"])
    a, b = (m.transform(snapshot).orderBy("particle_id").toPandas() for m in (fitted, loaded))
    assert a.equals(b) and len(a) == 300 and a.pred_label.sum() >= 30
    assert list(a.columns) == ["particle_id", "x", "y", "z", "vx", "vy", "vz", "r", "vr", "mass", "prob", "logit", "margin", "pred_label", *patches.FEATURES_16]


def test_margins_equal_sql_over_the_node_table(table, fitted):
    trees = PipelineModel(stages=fitted.stages[1:3])
    got = learning.score(trees, learning.node_margins(table, learning.node_table(trees), patches.FEATURES_16)).toPandas()
    np.testing.assert_allclose(got.margin, got.node_margin, atol=1e-12)


def test_loading_refuses_other_features(spark, fitted, table, tmp_path):
    flagship.save_flagship(fitted, str(tmp_path / "m"))
    swapped = list(patches.FEATURES_16[::-1])
    with pytest.raises(ValueError, match="features"):
        flagship.load_flagship(str(tmp_path / "m"), swapped)
    with pytest.raises(ValueError, match="patches of 12"):
        flagship.load_flagship(str(tmp_path / "m"), k=48)

    odd = PipelineModel(stages=[*fitted.stages[:-1], fitted.stages[-1].copy({fitted.stages[-1].featureOrder: swapped})])
    flagship.save_flagship(odd, str(tmp_path / "odd"))
    with pytest.raises(ValueError, match="metadata"):
        flagship.load_flagship(str(tmp_path / "odd"))
    PipelineModel(stages=fitted.stages[1:3]).write().save(str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="not a flagship"):
        flagship.load_flagship(str(tmp_path / "bare"))


def test_threshold_selection_without_correction(snapshot, fitted):
    trees = PipelineModel(stages=fitted.stages[1:3])
    out = pipelines.gbt_infer(trees, snapshot, k=12, prior=False, top_fraction=None, threshold=0.4).toPandas()
    assert (out.pred_label == (out.prob >= 0.4)).all()
    np.testing.assert_allclose(out.prob, 1 / (1 + np.exp(-out.margin)))


def test_patience_keeps_the_best_round():
    assert learning.best_round([5, 4, 3, 3, 3.5, 2], 10) == 5
    assert learning.best_round([5, 4, 3, 3, 3.5, 2], 2) == 2
    assert learning.best_round([1.0], 25) == 0
    assert learning.best_round([3, 2, 2, 2, 2, 1], 4) == 5 and learning.best_round([3, 2, 2, 2, 2, 1], 3) == 1


def test_rounds_are_cut_at_the_best_validation_loss(table):
    noisy = table.withColumn("is_stream", F.when(F.col("particle_id") % 4 == 0, 1 - F.col("is_stream")).otherwise(F.col("is_stream")))
    held = F.col("particle_id") % 4 == 0
    features = list(patches.FEATURES_16)
    model, report = learning.train_gbt_patient(noisy.where(~held), noisy.where(held), features, patience=3, maxIter=12, maxDepth=4, stepSize=0.5)
    full = learning.train_gbt(noisy.where(~held), features, maxIter=12, maxDepth=4, stepSize=0.5)
    losses = {r["round"]: r.logloss for r in learning.gbt_eval_history(full, noisy.where(held)).collect()}
    best = learning.best_round([losses[i] for i in range(12)], 3)
    assert report["best_iteration"] == best < 11 and model.stages[-1].getNumTrees == best + 1
    assert report["best_score"] == pytest.approx(losses[best])
    got = learning.score(model, noisy.where(held)).select(F.col("is_stream").alias("y_true"), "prob")
    p = got.toPandas()
    loss = -np.log(np.clip(np.where(p.y_true == 1, p.prob, 1 - p.prob), 1e-15, 1)).mean()
    assert loss == pytest.approx(losses[best])
    staged = learning.staged_losses(full, noisy.where(held)).orderBy("round").toPandas()
    np.testing.assert_allclose(staged.logloss, [losses[i] for i in range(12)])


def test_history_of_both_sets(table, fitted):
    trees = PipelineModel(stages=fitted.stages[1:3])
    held = F.col("particle_id") % 4 == 0
    sets = {"train": table.where(~held), "val": table.where(held)}
    got = learning.gbt_eval_history(trees, sets).toPandas()
    rounds = trees.stages[-1].getNumTrees
    assert got["set"].tolist() == ["train"] * rounds + ["val"] * rounds
    for name, part in sets.items():
        scored = learning.score(trees, part).select(F.col("is_stream").alias("y_true"), "prob")
        last = got[(got["set"] == name) & (got["round"] == rounds - 1)].iloc[0]
        assert last.auc == pytest.approx(metrics.roc_auc(scored).first().auc) and last.auprc == pytest.approx(metrics.average_precision(scored).first().auprc)


def test_empty_validation_is_refused(table):
    with pytest.raises(ValueError, match="no validation"):
        learning.train_gbt_patient(table, table.limit(0), list(patches.FEATURES_16), maxIter=1, maxDepth=1)


def test_history_over_many_parts_equals_the_metrics(table, fitted, monkeypatch):
    """Rounds are cut into parts; every area equals the one over all scores, and no row a round and row is made."""
    trees, held = PipelineModel(stages=fitted.stages[1:3]), F.col("particle_id") % 4 == 0
    sets = {"train": table.where(~held), "val": table.where(held)}
    monkeypatch.setattr(learning, "SCAN_ROWS", 40)
    sizes, plain = [], learning.cut_lineage
    monkeypatch.setattr(learning, "cut_lineage", lambda df: sizes.append(df.count()) or plain(df))
    got = learning.gbt_eval_history(trees, sets).toPandas().set_index(["set", "round"])
    rounds = trees.stages[-1].getNumTrees
    assert max(sizes) < 300 * rounds / 2
    for name, part in sets.items():
        for at in range(rounds):
            scored = learning.staged_scores(trees, part).where(F.col("round") == at).select("y_true", "prob").cache()
            row = got.loc[(name, at)]
            assert row.auc == pytest.approx(metrics.roc_auc(scored).first().auc) and row.auprc == pytest.approx(metrics.average_precision(scored).first().auprc)


def test_patience_that_ends_early_grows_no_further_rounds(table, monkeypatch):
    noisy = table.withColumn("is_stream", F.when(F.col("particle_id") % 4 == 0, 1 - F.col("is_stream")).otherwise(F.col("is_stream")))
    held, features = F.col("particle_id") % 4 == 0, list(patches.FEATURES_16)
    asked, plain = [], learning.train_gbt
    monkeypatch.setattr(learning, "train_gbt", lambda *a, **k: asked.append(k["maxIter"]) or plain(*a, **k))
    monkeypatch.setattr(learning, "FIRST_ROUNDS", 5)
    model, report = learning.train_gbt_patient(noisy.where(~held), noisy.where(held), features, patience=2, maxIter=12, maxDepth=3, stepSize=0.5)
    monkeypatch.setattr(learning, "FIRST_ROUNDS", 12)
    whole, want = learning.train_gbt_patient(noisy.where(~held), noisy.where(held), features, patience=2, maxIter=12, maxDepth=3, stepSize=0.5)
    assert asked == [5, 12] and report["best_iteration"] == want["best_iteration"] < 3
    rows = noisy.orderBy("particle_id")
    assert learning.score(model, rows).select("prob").toPandas().equals(learning.score(whole, rows).select("prob").toPandas())


def test_node_margins_walk_rows_in_batches(table, fitted):
    """No interpreted lambda a row, tree and level: 300 trees of depth 6 would be some 1 800 a row."""
    out = learning.node_margins(table, learning.node_table(PipelineModel(stages=fitted.stages[1:3])), patches.FEATURES_16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "node_margin" in out.columns
