"""Spark ML learners on the feature tables, model inspection, and a pluggable batch scorer."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType

from phasefold.functions.order import SCAN_ROWS
from phasefold.functions.phase import prior_correct
from phasefold.operators.metrics import select_threshold, select_top_fraction
from phasefold.session import cut_lineage, ensure_checkpoint_dir, small_side

# Boosting defaults.
GBT_DEFAULTS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42}


WALK_ROWS = 1024  # rows whose margins of all rounds a task holds at once
FIRST_ROUNDS = 100  # rounds grown before patience is asked for the first time
TRAIN_ROWS = 20_000  # rows of a training partition, at least: every level of every tree is a job over all partitions


def train_gbt(train: DataFrame, features: Sequence[str], label: str = "is_stream", validation: str | None = None, **params) -> PipelineModel:
    """Boosted trees on a feature table; ``validation`` names a boolean column that enables early stopping."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    settings = {**GBT_DEFAULTS, **params}
    learner = GBTClassifier(labelCol=label, featuresCol="features", checkpointInterval=10, **settings)
    if validation:
        learner = learner.setValidationIndicatorCol(validation)
    ensure_checkpoint_dir(train.sparkSession)
    train = train.coalesce(max(1, -(-train.count() // TRAIN_ROWS)))
    keep = [*features, label, *([validation] if validation else [])]
    data = assembler.transform(train.select(*keep).withColumn(label, F.col(label).cast("double")))
    return PipelineModel(stages=[assembler, learner.fit(data)])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add prob and margin (the log-odds, twice the raw tree sum)."""
    out = model.transform(df)
    return out.withColumns({
        "prob": vector_to_array("probability")[1], "margin": 2.0 * vector_to_array("rawPrediction")[1],
    }).drop("features", "rawPrediction", "probability", "prediction")


def select_scores(scored: DataFrame, pi_train: float = 0.5, pi_test: float = 0.07, prior: bool = True,
                  top_fraction: float | None = 0.07, threshold: float = 0.5) -> DataFrame:
    """Prior correction, then top-fraction or threshold selection."""
    if prior:
        scored = scored.withColumn("prob", prior_correct(F.col("prob"), pi_train, pi_test))
    return select_threshold(scored, threshold) if top_fraction is None else select_top_fraction(scored, top_fraction)


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """gain, weight, cover and their totals per feature, raw and normalised, ranked by gain."""
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in nodes.columns else F.struct(*nodes.columns)
    flat = nodes.select(node.alias("n")).select(
        F.col("n.split.featureIndex").alias("feature_index"), F.col("n.gain").alias("g"), F.col("n.rawCount").cast("double").alias("c"))
    used = flat.where("feature_index >= 0").groupBy("feature_index").agg(
        F.avg("g").alias("gain"), F.count(F.lit(1)).cast("double").alias("weight"), F.avg("c").alias("cover"),
        F.sum("g").alias("total_gain"), F.sum("c").alias("total_cover"))
    kinds = ("gain", "weight", "cover", "total_gain", "total_cover")
    named = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "feature_index int, feature string")
    full = named.join(F.broadcast(used), "feature_index", "left").fillna(0.0, subset=list(kinds))  # one row per feature
    totals = full.agg(*[F.sum(k).alias(f"_{k}") for k in kinds])
    out = full.join(F.broadcast(totals))
    out = out.withColumns({f"{k}_norm": F.when(F.col(f"_{k}") > 0, F.try_divide(F.col(k), F.col(f"_{k}"))).otherwise(0.0) for k in kinds})
    return out.drop(*[f"_{k}" for k in kinds]).orderBy(F.col("gain_norm").desc(), "feature_index")


def node_table(model: PipelineModel) -> DataFrame:
    """The trees as rows: tree, node, feature (-1 at a leaf), threshold, left, right, prediction, weight.

    At most rounds x 2^(depth + 1) rows, whatever the training data.
    """
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.stages[-1].write().overwrite().save(path)
    return read_nodes(spark, path, model.stages[-1].treeWeights)


def read_nodes(spark: SparkSession, path: str, weights: Sequence[float]) -> DataFrame:
    """``node_table`` of saved boosted trees with the given tree weights."""
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), F.when(node["leftChild"] >= 0, node["split"]["featureIndex"]).otherwise(-1).alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["prediction"].alias("prediction"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("treeID") + 1).alias("weight"))


def node_margins(df: DataFrame, nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``node_margin``: the margin without Spark's predictor, every tree walked down its node table.

    An independent check of a saved model; the trees are of bounded size and travel with the tasks, the rows are walked in batches.
    """
    margins, features = _staged_kernel(nodes), list(features)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])
            last = [margins(x[at:at + WALK_ROWS])[-1] for at in range(0, len(x), WALK_ROWS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*last, np.zeros(0)]))], names=[*batch.schema.names, "node_margin"])

    return df.mapInArrow(walk, ", ".join([*_typed(df), "node_margin double"]))


def _staged_kernel(nodes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Function from (n, features) to (rounds, n): the margin (log-odds) after every boosting round."""
    rows = nodes.orderBy("tree", "node").toPandas()
    trees = []
    for _, t in rows.groupby("tree", sort=True):
        if not np.array_equal(t.node, np.arange(len(t))):
            raise ValueError("a tree's nodes must be numbered from 0")
        trees.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "prediction")) + (float(t.weight.iloc[0]),))

    def margins(x: np.ndarray) -> np.ndarray:
        out, every = np.empty((len(trees), len(x))), np.arange(len(x))
        for i, (feature, threshold, left, right, prediction, weight) in enumerate(trees):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                low = x[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out[i] = prediction[at] * weight
        return 2.0 * np.cumsum(out, axis=0)

    return margins


def staged_scores(model: PipelineModel, df: DataFrame, label: str = "is_stream", carry: Sequence[str] = ()) -> DataFrame:
    """(carry..., y_true, round, prob): one row per row and round, each tree walked once."""
    features, margins, carry = model.stages[0].getInputCols(), _staged_kernel(node_table(model)), list(carry)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                m = margins(np.column_stack([part.column(f).to_numpy(zero_copy_only=False) for f in features]))
                take = pa.array(np.tile(np.arange(m.shape[1]), len(m)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(take) for c in carry], part.column("y_true").take(take), pa.array(np.repeat(np.arange(len(m), dtype=np.int32), m.shape[1])),
                     pa.array(1.0 / (1.0 + np.exp(-m.ravel())))], names=[*carry, "y_true", "round", "prob"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in carry], "y_true int, round int, prob double"])
    return df.select(*carry, F.col(label).cast("int").alias("y_true"), *[F.col(f).cast("double") for f in features]).mapInArrow(spread, schema)


def staged_losses(model: PipelineModel, df: DataFrame, label: str = "is_stream") -> DataFrame:
    """(round, logloss): a task sends one sum a round, not its rows."""
    features, margins = model.stages[0].getInputCols(), _staged_kernel(node_table(model))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            p = np.clip(1.0 / (1.0 + np.exp(-margins(x))), 1e-15, 1.0 - 1e-15)
            total = total - np.log(np.where(batch.column("y_true").to_numpy() == 1, p, 1.0 - p)).sum(axis=1)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["round", "loss", "n"])

    rows = df.select(F.col(label).cast("int").alias("y_true"), *[F.col(f).cast("double") for f in features]).mapInArrow(sums, "round int, loss double, n bigint")
    return rows.groupBy("round").agg((F.sum("loss") / F.sum("n")).alias("logloss"))


def best_round(losses: Sequence[float], patience: int) -> int:
    """The round to keep: the best one before ``patience`` rounds passed without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The same model with its first boosting rounds only."""
    trees = model.stages[-1]
    jvm, gateway = SparkSession.active()._jvm, SparkSession.active().sparkContext._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], weights[i] = trees.trees[i]._java_obj, float(trees.treeWeights[i])
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(trees.uid, kept, weights, trees.numFeatures, trees.numClasses)
    cut = GBTClassificationModel(trees._java_obj.copyValues(java, trees._java_obj.extractParamMap()))
    cut._resetUid(trees.uid)
    cut._transfer_params_from_java()
    return PipelineModel(stages=[*model.stages[:-1], cut])


def train_gbt_patient(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str = "is_stream", patience: int = 25, **params) -> tuple[PipelineModel, dict]:
    """Boosted trees cut at the best validation round: (model, {best_iteration, best_score, rounds}).

    The validation rows are scored once for every round grown.  The best round is the one that no better one followed
    within ``patience`` rounds, so later rounds can't change the answer.  Rounds do not depend on how many follow: the
    first ``FIRST_ROUNDS`` are grown alone, and all of them only if patience has not ended by then.
    """
    most = {**GBT_DEFAULTS, **params}["maxIter"]
    for rounds in sorted({min(max(FIRST_ROUNDS, patience), most), most}):
        grown = train_gbt(train, features, label, **{**params, "maxIter": rounds})
        losses = [r.logloss for r in staged_losses(grown, validation, label).orderBy("round").collect()]  # one row per round
        if not losses:
            raise ValueError("no validation rows")
        best = best_round(losses, patience)
        if best + patience < len(losses):
            break
    return first_rounds(grown, best + 1), {"best_iteration": best, "best_score": float(losses[best]), "rounds": len(losses)}


def gbt_eval_history(model: PipelineModel, sets: DataFrame | dict[str, DataFrame], label: str = "is_stream") -> DataFrame:
    """Log-loss, AUC and average precision after every boosting round; with named sets one block of rows a set (``set``).

    The scores of a round travel sorted and packed, cut into parts of about ``SCAN_ROWS`` rows at values taken from a
    sample, which only balances the parts.  Part totals give every part what lies below and above it, so the areas are exact.
    """
    named, features, margins = {"": sets} if isinstance(sets, DataFrame) else sets, model.stages[0].getInputCols(), _staged_kernel(node_table(model))
    rows = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("set"), F.col(label).cast("int").alias("y_true"), *[F.col(f).cast("double") for f in features])
        rows = part if rows is None else rows.unionByName(part)
    total = rows.count()
    parts = max(1, -(-total // SCAN_ROWS))
    cuts = None
    if parts > 1:
        sample = rows.where(F.rand(7) < F.lit(64.0 * parts / total)).select(*features).toPandas().to_numpy()  # some 64 rows a part
        cuts = np.quantile(1.0 / (1.0 + np.exp(-margins(sample))), np.arange(1, parts) / parts, axis=1).T if len(sample) else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, y = batch.column("set").to_numpy(zero_copy_only=False), batch.column("y_true").to_numpy(zero_copy_only=False) == 1
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            for name in dict.fromkeys(names):
                mine = np.flatnonzero(names == name)
                for at in range(0, len(mine), WALK_ROWS):
                    take = mine[at:at + WALK_ROWS]
                    prob, pos = 1.0 / (1.0 + np.exp(-margins(x[take]))), y[take]
                    clipped = np.clip(prob, 1e-15, 1.0 - 1e-15)
                    loss = -np.log(np.where(pos, clipped, 1.0 - clipped))
                    order = np.argsort(prob, axis=1)
                    prob, pos, loss = np.take_along_axis(prob, order, 1), pos[order], np.take_along_axis(loss, order, 1)
                    ends = [[0, *([] if cuts is None else np.searchsorted(prob[r], cuts[r])), len(take)] for r in range(len(prob))]
                    runs = [(r, p, r * len(take) + e[p], r * len(take) + e[p + 1]) for r, e in enumerate(ends) for p in range(len(e) - 1) if e[p] < e[p + 1]]
                    r, p, a, b = (np.array(c, np.int64) for c in zip(*runs))
                    n_pos = np.add.reduceat(pos.ravel().astype(np.int64), a)
                    offsets = pa.array(np.append(a, prob.size).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(r)), pa.array(r.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(np.add.reduceat(loss.ravel(), a)), pa.array(n_pos),
                         pa.array(b - a - n_pos), pa.ListArray.from_arrays(offsets, pa.array(prob.ravel())), pa.ListArray.from_arrays(offsets, pa.array(pos.ravel()))],
                        names=["set", "round", "part", "loss", "n_pos", "n_neg", "probs", "positive"])

    def areas(table: pa.Table) -> pa.Table:
        below, above_pos, above_neg = (table.column(c)[0].as_py() for c in ("_below", "_above_pos", "_above_neg"))
        probs, at = np.unique(table.column("probs").combine_chunks().flatten().to_numpy(), return_inverse=True)
        positive = table.column("positive").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        pos, neg = (np.bincount(at[kind], minlength=len(probs)).astype(np.int64) for kind in (positive, ~positive))
        wins = (pos * (below + np.cumsum(neg) - neg / 2.0)).sum()
        down_pos, down_neg = above_pos + np.cumsum(pos[::-1])[::-1], above_neg + np.cumsum(neg[::-1])[::-1]
        steps = (pos * (down_pos / (down_pos + down_neg))).sum()
        return pa.table({"set": table.column("set").slice(0, 1), "round": table.column("round").slice(0, 1), "_w": [float(wins)], "_s": [float(steps)]})

    packed = cut_lineage(rows.mapInArrow(pack, "set string, round int, part int, loss double, n_pos bigint, n_neg bigint, probs array<double>, positive array<boolean>"))
    keys = ["set", "round"]
    totals = cut_lineage(packed.groupBy(*keys, "part").agg(*[F.sum(c).alias(c) for c in ("loss", "n_pos", "n_neg")]))  # a row a round and part
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    over = lambda c, w, name: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(name)
    offsets = totals.select(*keys, "part", over("n_neg", before, "_below"), over("n_pos", after, "_above_pos"), over("n_neg", after, "_above_neg"))
    sums = packed.select(*keys, "part", "probs", "positive").join(small_side(offsets), [*keys, "part"]).groupBy(*keys, "part").applyInArrow(
        areas, "set string, round int, _w double, _s double").groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"))
    known = totals.groupBy(*keys).agg(F.sum("loss").alias("_loss"), F.sum("n_pos").cast("double").alias("_p"), F.sum("n_neg").cast("double").alias("_n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    out = known.join(sums, keys).select(
        *keys, (F.col("_loss") / (F.col("_p") + F.col("_n"))).alias("logloss"), ratio(F.col("_w"), F.col("_p") * F.col("_n")).alias("auc"),
        ratio(F.col("_s"), F.col("_p")).alias("auprc")).orderBy(*keys)
    return out.drop("set") if isinstance(sets, DataFrame) else out


def train_mlp(train: DataFrame, features: Sequence[str], label: str = "is_stream", hidden: Sequence[int] = (32, 64), **params) -> PipelineModel:
    """Summary classifier: inputs -> 32 -> 64 -> 2."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    learner = MultilayerPerceptronClassifier(layers=[len(features), *hidden, 2], labelCol=label, featuresCol="features",
                                             **{"seed": 42, "maxIter": 100, **params})
    data = assembler.transform(train.select(*features, F.col(label).cast("double").alias(label)))
    return PipelineModel(stages=[assembler, learner.fit(data)])


def batch_scorer(make_predict: Callable, width: int, batch_size: int = 4096) -> Callable[[Sequence[Column]], Column]:
    """Vectorised scorer hook: ``make_predict()`` loads the model once per worker and returns
    a function of a (batch, width) float matrix giving one score per row."""
    scorer = predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]])
    return lambda cols: scorer(F.array(*[c.cast("float") for c in cols]))


def score_tiles(cells: DataFrame, tile: Sequence[str], features: Sequence[str], make_predict: Callable, max_cells: int = 262_144, order: Sequence[str] = (),
                prob: str = "prob") -> DataFrame:
    """Score cells by a model that looks at whole tiles: the cells with a column ``prob``.

    ``make_predict()`` loads the model once a task and returns ``f(matrix, offsets)``: the cells of several tiles below
    each other, tile i in rows offsets[i] to offsets[i + 1], one score per cell.  A call gets at most ``max_cells``
    cells, the bound of a device's memory; a tile above it is handed over in runs of that many cells, ``order`` first,
    as tiles of their own.  Cells are streamed, so a task holds one call's cells, whatever a tile holds.
    """
    if max_cells < 1 or not tile:
        raise ValueError("score_tiles needs tile columns and a positive max_cells")
    tile, features, carried = list(tile), list(features), cells.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict, held, sizes, last = make_predict(), [], [], None

        def call() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            matrix = np.column_stack([rows.column(f).to_numpy(zero_copy_only=False) for f in features])
            out = np.asarray(predict(matrix, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), dtype=np.float64)
            if out.shape != (rows.num_rows,):
                raise ValueError(f"the scorer returned {out.shape} for {rows.num_rows} cells")
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(out)], names=[*carried, prob])

        for batch in batches:
            keys = list(zip(*[batch.column(t).to_pylist() for t in tile]))
            at = 0
            while at < batch.num_rows:
                end = at + 1
                while end < batch.num_rows and keys[end] == keys[at]:
                    end += 1
                if keys[at] != last or not sizes:
                    sizes.append(0)
                last = keys[at]
                if sum(sizes) + end - at > max_cells and len(sizes) > 1:
                    # the tile that is still growing moves to the next call, the finished ones are scored
                    flat, grown = pa.Table.from_batches(held), sizes[-1]
                    held, sizes = flat.slice(0, flat.num_rows - grown).to_batches(), sizes[:-1]
                    yield call()
                    held, sizes = flat.slice(flat.num_rows - grown).to_batches() if grown else [], [grown]
                elif sizes[0] == max_cells:
                    yield call()  # a tile above the bound goes on as a tile of its own
                    held, sizes = [], [0]
                take = min(end - at, max_cells - sum(sizes))
                held.append(batch.slice(at, take))
                sizes[-1] += take
                at += take
        if sum(sizes):
            yield call()

    laid = cells.repartition(*tile).sortWithinPartitions(*tile, *order)
    schema = ", ".join([*_typed(cells), f"{prob} double"])
    return laid.mapInArrow(score, schema)


def _typed(df: DataFrame) -> list[str]:
    return [f"`{name}` {kind}" for name, kind in df.dtypes]
