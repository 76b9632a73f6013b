"""The boosted-tree flagship as one saved pipeline: patch features, trees, prior correction, selection, outputs.

``fit_flagship`` returns a ``PipelineModel`` of four stages.  It can be saved with
``save_flagship`` and loaded elsewhere with ``load_flagship``; ``transform`` turns a
raw snapshot into the rich outputs.  The settings that a later run must share
(neighbour count, space, velocity weight, priors, feature order) are stage
parameters and so part of the saved files, and loading refuses a model whose
features are not the asked ones in the asked order.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from phasefold.functions.phase import BASE, phase_columns
from phasefold.operators import learning, metrics, neighbours, patches
from phasefold.sources.cleaning import clean_snapshot, default_columns
from phasefold.sources.sinks import particle_outputs

# Neighbours of a patch, weight of velocities in its space, share of stream rows in training and in a snapshot.
K, SPACE, VEL_WEIGHT, TRAIN_PRIOR, TEST_PRIOR = 48, "xyzv", 0.05, 0.5, 0.07
CARRIED = (*BASE, "r", "vr", "mass")


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class PatchFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A snapshot, cleaned, with the 16 features of each particle's neighbour patch."""

    k = _param("k", "neighbours of a patch, itself included", TypeConverters.toInt)
    space = _param("space", "xyz or xyzv", TypeConverters.toString)
    velWeight = _param("velWeight", "weight of velocities in the neighbour space", TypeConverters.toFloat)

    def __init__(self, k: int = K, space: str = SPACE, vel_weight: float = VEL_WEIGHT):
        super().__init__()
        self._set(k=k, space=space, velWeight=vel_weight)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        clean = phase_columns(default_columns(clean_snapshot(dataset), order="particle_id"), 8, "floor").select("particle_id", *CARRIED)
        space = self.getOrDefault(self.space)
        spaced = neighbours.space_columns(clean, space, self.getOrDefault(self.velWeight))
        found = neighbours.knn_patches(spaced, self.getOrDefault(self.k), neighbours.space_dims(space), payload=list(BASE))
        return patches.patch_features16(found, keep=CARRIED)


class SelectStream(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Tree outputs to probability, log-odds, prior correction, selection and the rich output columns."""

    trainPrior = _param("trainPrior", "share of stream rows in training", TypeConverters.toFloat)
    testPrior = _param("testPrior", "share of stream rows expected in a snapshot", TypeConverters.toFloat)
    correctPrior = _param("correctPrior", "whether probabilities are corrected", TypeConverters.toBoolean)
    topFraction = _param("topFraction", "share of rows to select; above 1, select by threshold", TypeConverters.toFloat)
    threshold = _param("threshold", "probability to select from", TypeConverters.toFloat)
    featureOrder = _param("featureOrder", "features in the order of the model's vector", TypeConverters.toListString)
    metadata = _param("metadata", "JSON: training report", TypeConverters.toString)

    def __init__(self, train_prior: float = TRAIN_PRIOR, test_prior: float = TEST_PRIOR, correct_prior: bool = True, top_fraction: float = 0.07,
                 threshold: float = 0.5, feature_order: Sequence[str] = patches.FEATURES_16, metadata: str = "{}"):
        super().__init__()
        self._set(trainPrior=train_prior, testPrior=test_prior, correctPrior=correct_prior, topFraction=top_fraction, threshold=threshold,
                  featureOrder=list(feature_order), metadata=metadata)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = lambda p: self.getOrDefault(getattr(self, p))
        scored = dataset.withColumns({"prob": vector_to_array("probability")[1], "margin": 2.0 * vector_to_array("rawPrediction")[1]})
        scored = scored.drop("features", "rawPrediction", "probability", "prediction").withColumn("logit", F.col("margin"))
        fraction = get("topFraction")
        chosen = learning.select_scores(scored, get("trainPrior"), get("testPrior"), get("correctPrior"), None if fraction > 1.0 else fraction, get("threshold"))
        return particle_outputs(chosen, get("featureOrder"))


def assemble(trees: PipelineModel, k: int = K, space: str = SPACE, vel_weight: float = VEL_WEIGHT, metadata: dict | None = None, **selection) -> PipelineModel:
    """Trees from ``learning.train_gbt`` with everything around them, from snapshot to outputs."""
    order = trees.stages[0].getInputCols()
    return PipelineModel(stages=[PatchFeatures(k, space, vel_weight), *trees.stages, SelectStream(feature_order=order, metadata=json.dumps(metadata or {}), **selection)])


def fit_flagship(train: DataFrame, validation: DataFrame | None = None, k: int = K, vel_weight: float = VEL_WEIGHT, patience: int = 25, selection: dict | None = None,
                 **params) -> PipelineModel:
    """Train on feature tables (16 features and ``is_stream``) and wrap the trees; with ``validation`` the rounds stop early."""
    features = list(patches.FEATURES_16)
    if validation is None:
        trees, report = learning.train_gbt(train, features, **params), {}
    else:
        trees, report = learning.train_gbt_patient(train, validation, features, patience=patience, **params)
        scored = learning.score(trees, validation).select(F.col("is_stream").alias("y_true"), "prob")
        final = metrics.binary_metrics(scored).join(metrics.roc_auc(scored)).join(metrics.average_precision(scored)).first()
        report["final_val_metrics"] = {name: float(value) for name, value in final.asDict().items()}
    top = learning.feature_importance(trees, features).limit(10).collect()
    report["top_features_by_gain"] = [r.feature for r in top]
    return assemble(trees, k, SPACE, vel_weight, report, **(selection or {}))


def metadata_of(model: PipelineModel) -> dict:
    """Everything a later run must know, from the stages themselves."""
    first, last = model.stages[0], model.stages[-1]
    get = lambda stage, p: stage.getOrDefault(getattr(stage, p))
    return {"k": get(first, "k"), "space": get(first, "space"), "vel_weight": get(first, "velWeight"), "train_prior": get(last, "trainPrior"),
            "test_prior": get(last, "testPrior"), "feature_order": get(last, "featureOrder"), **json.loads(get(last, "metadata"))}


def save_flagship(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_flagship(path: str, features: Sequence[str] = patches.FEATURES_16, k: int | None = None) -> PipelineModel:
    """A saved model; refuses one whose stages, features, feature order or (if given) neighbour count differ."""
    model = PipelineModel.load(path)
    kinds = [type(s) for s in model.stages]
    if kinds != [PatchFeatures, VectorAssembler, GBTClassificationModel, SelectStream]:
        raise ValueError(f"not a flagship model: {[t.__name__ for t in kinds]}")
    known = metadata_of(model)
    for source, order in (("metadata", known["feature_order"]), ("assembler", model.stages[1].getInputCols())):
        if list(order) != list(features):
            raise ValueError(f"the model's features ({source}) are {list(order)}, not {list(features)}")
    if model.stages[2].numFeatures != len(features):
        raise ValueError(f"the trees read {model.stages[2].numFeatures} features, not {len(features)}")
    if k is not None and known["k"] != k:
        raise ValueError(f"the model was trained on patches of {known['k']} rows, not {k}")
    return model
