import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasefold.operators import learning, losses, maps, metrics, patches
from phasefold.plans import pipelines


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    y = (rng.random(800) < 0.3).astype(int)
    return pd.DataFrame({"y_true": y, "prob": np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0.01, 0.99), 2)})


def test_auc_and_average_precision(spark, frame):
    df = spark.createDataFrame(frame)
    pos, neg = frame.prob[frame.y_true == 1].to_numpy(), frame.prob[frame.y_true == 0].to_numpy()
    want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert metrics.roc_auc(df).first().auc == pytest.approx(want)
    cuts = np.sort(frame.prob.unique())[::-1]
    tp = np.array([(pos >= c).sum() for c in cuts])
    fp = np.array([(neg >= c).sum() for c in cuts])
    recall = tp / len(pos)
    ap = (np.diff(np.concatenate([[0], recall])) * tp / (tp + fp)).sum()
    assert metrics.average_precision(df).first().auprc == pytest.approx(ap)
    one = df.where("y_true = 1")
    assert np.isnan(metrics.roc_auc(one).first().auc)


def test_sweep_equals_single_thresholds(spark, frame):
    df = spark.createDataFrame(frame)
    swept = metrics.threshold_sweep(df).toPandas().set_index("threshold")
    for t in metrics.SWEEP_THRESHOLDS:
        single = metrics.binary_metrics(df, t).toPandas().iloc[0]
        pd.testing.assert_series_equal(swept.loc[t, list(metrics.METRICS)], single[list(metrics.METRICS)], check_names=False)
    pred, y = frame.prob >= 0.5, frame.y_true == 1
    assert swept.loc[0.5, "mcc"] == pytest.approx(np.corrcoef(pred, y)[0, 1])
    empty = metrics.binary_metrics(df.limit(0)).first()
    assert empty.acc == 0 and empty.mcc == 0


def test_top_fraction_keeps_ties(spark):
    df = spark.createDataFrame(pd.DataFrame({"prob": [0.1] * 5 + [0.9] * 5}))
    assert metrics.select_top_fraction(df, 0.07).where("selected").count() == 5
    assert metrics.select_top_fraction(df, 1.0).where("selected").count() == 10


def test_losses(spark, frame):
    df = spark.createDataFrame(frame)
    p, y = frame.prob.to_numpy(), frame.y_true.to_numpy()
    ce = -np.where(y == 1, np.log(p), np.log(1 - p))
    assert losses.cross_entropy(df).first().loss == pytest.approx(ce.mean())
    n1, n0 = y.sum(), (1 - y).sum()
    w = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    assert losses.balanced_cross_entropy(df).first().loss == pytest.approx((w * ce).sum() / w.sum())
    sims = []
    for a, b in ((p, y), (1 - p, 1 - y)):
        pl, both = (a * b).sum(), (a * a).sum() + (b * b).sum()
        sims.append(np.mean([pl / (2**d * both - (2 ** (d + 1) - 1) * pl) for d in range(3)]))
    assert losses.tanimoto(df, 2).first().loss == pytest.approx(1 - np.mean(sims))


def test_smoothing_matches_dense_convolution(spark):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 3, size=(30, 30)).astype(float)
    rows = [(int(i), int(j), float(image[j, i])) for j, i in np.argwhere(image >= 0)]
    got = maps.smooth(spark.createDataFrame(rows, ["px", "py", "v"]).where("v > 0"), ["v"], 1.6, 30).toPandas()
    kernel = np.array([w for _, w in maps.gaussian_kernel(1.6)])
    want = np.apply_along_axis(lambda m: np.convolve(m, kernel, mode="same"), 0, image)
    want = np.apply_along_axis(lambda m: np.convolve(m, kernel, mode="same"), 1, want)
    dense = np.zeros_like(image)
    dense[got.py, got.px] = got.v
    np.testing.assert_allclose(dense, want, atol=1e-12)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (1.0001, 0.0, 0.0)], ["x", "y", "z"])
    got = {(r.px, r.py): r.n for r in maps.density_map(df, (-1, 1, -1, 1), "xy", 4).collect()}
    assert got == {(0, 2): 1, (3, 3): 1}


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((24, 24)) < 0.4
    mask[3, :] = True
    want, seen = {}, set()
    for y, x in np.argwhere(mask):
        if (x, y) in seen:
            continue
        stack, label = [(x, y)], int(y) * 24 + int(x)
        seen.add((x, y))
        while stack:
            a, b = stack.pop()
            want[(int(a), int(b))] = label
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    q = (a + da, b + db)
                    if 0 <= q[0] < 24 and 0 <= q[1] < 24 and mask[q[1], q[0]] and q not in seen:
                        seen.add(q)
                        stack.append(q)
    df = spark.createDataFrame([(int(x), int(y)) for y, x in np.argwhere(mask)], ["px", "py"])
    for block in (256, 8, 5, 1):  # one block, several, and every pixel a block
        got = {(r.px, r.py): r.label for r in maps.components(df, 24, block=block).collect()}
        assert got == want
    assert maps.components(df.limit(0), 24).count() == 0


def test_components_that_wind_through_blocks(spark):
    """A spiral crosses block borders again and again and is one component."""
    n, x, y, d, cells = 40, 0, 0, 0, set()
    moves = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    length, run = n - 1, [n - 1]
    while length > 0:
        run += [length, length]
        length -= 2
    cells.add((x, y))
    for k in run:
        for _ in range(k):
            x, y = x + moves[d][0], y + moves[d][1]
            cells.add((x, y))
        d = (d + 1) % 4
    df = spark.createDataFrame(sorted(cells), ["px", "py"])
    got = maps.components(df, n, block=8).collect()
    assert len(got) == len(cells) and {r.label for r in got} == {0}


def test_boosted_trees_and_their_report(spark, cloud):
    few = cloud.drop_duplicates(["x", "y", "z"]).head(300)
    table = pipelines.patch_feature_table(spark.createDataFrame(few), 12, keep=["is_stream"]).cache()
    model = learning.train_gbt(table, patches.FEATURES_16, maxIter=4, maxDepth=3)
    history = learning.gbt_eval_history(model, table).toPandas()
    assert history["round"].tolist() == [0, 1, 2, 3] and history.logloss.is_monotonic_decreasing
    scored = learning.score(model, table)
    final = metrics.roc_auc(scored.withColumnRenamed("is_stream", "y_true")).first().auc
    assert history.auc.iloc[-1] == pytest.approx(final)
    imp = learning.feature_importance(model, patches.FEATURES_16).toPandas()
    assert len(imp) == 16 and imp.gain_norm.is_monotonic_decreasing
    assert imp.weight_norm.sum() == pytest.approx(1.0) and (imp.weight >= 0).all()
    used = sum(t.numNodes - (t.numNodes + 1) // 2 for t in model.stages[-1].trees)
    assert imp.weight.sum() == used
    chosen = learning.select_scores(scored, top_fraction=0.1)
    assert chosen.where("selected").count() >= 30


def test_batch_scorer(spark):
    scorer = learning.batch_scorer(lambda: (lambda m: m.sum(axis=1).astype("float64")), 2)
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b"))
    assert [r[0] for r in df.select(scorer([F.col("a"), F.col("b")])).collect()] == [i + 2.0 for i in range(10)]


@pytest.mark.parametrize("bound", [1000, 40, 17, 5])
def test_tile_scorer_sees_whole_tiles(spark, bound):
    """Every tile within the bound reaches one call whole; calls stay within it; larger tiles come in ordered runs."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"ti": np.repeat(np.arange(30), rng.integers(1, 18, 30))})
    frame["g"] = frame.groupby("ti").cumcount()
    frame["f"] = rng.normal(size=len(frame))

    def make():
        def predict(matrix, offsets):
            assert len(matrix) == offsets[-1] <= bound and (np.diff(offsets) > 0).all()
            out = np.empty(len(matrix))
            for a, b in zip(offsets[:-1], offsets[1:]):
                out[a:b] = 1000 * (b - a) + matrix[a:b, 0] - matrix[a:b, 0].mean()
            return out
        return predict

    cells = spark.createDataFrame(frame.sample(frac=1, random_state=2)).repartition(5)
    got = learning.score_tiles(cells, ["ti"], ["f"], make, max_cells=bound, order=["g"]).toPandas().sort_values(["ti", "g"])
    want = frame.assign(run=frame.g // bound if bound < 17 else 0)
    size, mean = (want.groupby(["ti", "run"]).f.transform(x) for x in ("size", "mean"))
    np.testing.assert_allclose(got.prob, 1000 * size + want.f - mean)
    assert got.f.tolist() == frame.f.tolist()
    with pytest.raises(ValueError):
        learning.score_tiles(cells, ["ti"], ["f"], make, max_cells=0)
    assert learning.score_tiles(cells.limit(0), ["ti"], ["f"], make).count() == 0
