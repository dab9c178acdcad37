"""Clustering and classification with Spark ML, and batch scoring.

Two kinds of models have no Spark ML twin and are mapped:
external boosters (level-wise or leaf-wise) become gradient-boosted trees through
:func:`booster_params`, and feed-forward networks become the multilayer perceptron
(sigmoid hidden layers, softmax output, no dropout).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raregrain.functions.vectors import class1_probability
from raregrain.operators.boosting import BoostedTrees, boost
from raregrain.operators.few_rows import FewRows
from raregrain.operators.stats import class_weights

#: Metrics that each evaluator accepts; anything else is refused before a job starts.
BINARY_METRICS = ("areaUnderROC", "areaUnderPR")
MULTICLASS_METRICS = ("f1", "accuracy", "weightedPrecision", "weightedRecall", "logLoss")


def evaluator(metric: str, label: str = "binds", raw: str = "rawPrediction"):
    """Evaluator for a metric name; curve areas are exact (no binning of scores)."""
    if metric in BINARY_METRICS:
        return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName=metric, numBins=0)
    if metric in MULTICLASS_METRICS:
        return MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    raise ValueError(f"unknown metric {metric!r}; use one of {BINARY_METRICS + MULTICLASS_METRICS}")


def fit_kmeans(df: DataFrame, k: int = 2, seed: int = 42, features: str = "vectors", out: str = "cluster") -> Model:
    """k-means with the cluster in column ``out``."""
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=out).fit(df)


def fit_random_forest(
    df: DataFrame, label: str = "binds", features: str = "vectors", trees: int = 100, seed: int = 42, **params: object
) -> Model:
    """Random forest."""
    return RandomForestClassifier(
        labelCol=label, featuresCol=features, numTrees=trees, probabilityCol="probability", seed=seed, **params
    ).fit(df)


def gbt(label: str = "binds", features: str = "vectors", weight: str | None = None, **params: object) -> GBTClassifier:
    """Gradient-boosted trees, not yet fitted."""
    settings = {"maxIter": 100, "maxMemoryInMB": 3072, "cacheNodeIds": True, "seed": 42, **params}
    if weight is not None:
        settings["weightCol"] = weight
    return GBTClassifier(labelCol=label, featuresCol=features, **settings)


def fit_gbt(df: DataFrame | FewRows, label: str = "binds", features: str = "vectors", weight: str | None = None, **params: object) -> Model | BoostedTrees:
    """Gradient-boosted trees, optionally on weighted rows; the same trees, grown in memory, for :class:`FewRows`, which have their weights."""
    if isinstance(df, FewRows):
        tree = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 5, **params}
        return boost(df, tree.pop("maxIter"), None, label, features, weight, tree.pop("stepSize"), **tree)
    return gbt(label, features, weight, **params).fit(df)


def booster_params(params: Mapping[str, object], ignore: Sequence[str] = ()) -> dict[str, object]:
    """Booster parameters expressed as gradient-boosted-tree parameters.

    A parameter without a counterpart (penalties, column sampling, typing errors) is an error unless
    ``ignore`` names it. ``scale_pos_weight`` is a row weight, see :func:`fit_booster`.
    """
    names = {
        "eta": "stepSize",
        "learning_rate": "stepSize",
        "n_estimators": "maxIter",
        "num_boost_round": "maxIter",
        "max_depth": "maxDepth",
        "subsample": "subsamplingRate",
        "gamma": "minInfoGain",
        "seed": "seed",
        "min_child_weight": "minInstancesPerNode",
    }
    unknown = sorted(set(params) - set(names) - {"scale_pos_weight"} - set(ignore))
    if unknown:
        raise ValueError(f"no counterpart for {unknown}; name them in ignore to leave them out")
    mapped = {names[k]: v for k, v in params.items() if k in names}
    if "minInstancesPerNode" in mapped:
        mapped["minInstancesPerNode"] = max(1, math.ceil(mapped["minInstancesPerNode"]))
    if int(mapped.get("maxDepth", 0)) > 30:
        raise ValueError("trees are at most 30 levels deep")
    return mapped


def fit_booster(
    df: DataFrame, params: Mapping[str, object], label: str = "binds", features: str = "vectors", weight: str | None = None, ignore: Sequence[str] = ()
) -> Model:
    """Boosted trees from booster parameters; ``scale_pos_weight`` multiplies the weight of class 1."""
    mapped = booster_params(params, ignore)
    scale = float(params.get("scale_pos_weight", 1.0))
    if scale != 1.0:
        own = F.lit(1.0) if weight is None else F.col(weight)
        df, weight = df.withColumn("_weight", F.when(F.col(label) == 1, own * scale).otherwise(own)), "_weight"
    return fit_gbt(df, label, features, weight, **mapped)


def fit_unbalanced_booster(df: DataFrame, label: str = "binds", features: str = "vectors", **params: object) -> Model:
    """Boosted trees on rows weighted to balance the classes."""
    return fit_gbt(class_weights(df, label, out="_weight"), label, features, "_weight", **params)


def logistic(label: str = "binds", features: str = "vectors", **params: object) -> LogisticRegression:
    """Logistic regression, not yet fitted."""
    return LogisticRegression(labelCol=label, featuresCol=features, **{"maxIter": 1000, **params})


def fit_logistic(df: DataFrame, label: str = "binds", features: str = "vectors", **params: object) -> Model:
    """Logistic regression."""
    return logistic(label, features, **params).fit(df)


def fit_logistic_cv(
    df: DataFrame,
    label: str = "binds",
    features: str = "vectors",
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
    folds: int = 10,
    seed: int = 42,
    parallelism: int = 4,
    fold_col: str | None = None,
    **params: object,
) -> CrossValidatorModel:
    """Logistic regression with its penalty chosen by cross-validated area under PR."""
    estimator = logistic(label, features, **params)
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(reg_params)).build()
    extra = {} if fold_col is None else {"foldCol": fold_col}
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator("areaUnderPR", label),
        numFolds=folds, seed=seed, parallelism=parallelism, **extra,
    ).fit(df)


def fit_mlp(
    df: DataFrame,
    layers: Sequence[int],
    label: str = "binds",
    features: str = "vectors",
    max_iter: int = 100,
    seed: int = 42,
    initial_weights: object | None = None,
    **params: object,
) -> Model:
    """Feed-forward classifier; ``initial_weights`` continues from an earlier fit."""
    settings = {"maxIter": max_iter, "seed": seed, "layers": list(layers), **params}
    if initial_weights is not None:
        settings["initialWeights"] = initial_weights
    return MultilayerPerceptronClassifier(labelCol=label, featuresCol=features, **settings).fit(df)


def perceptron_model(
    spark: SparkSession, weights: Sequence[float], layers: Sequence[int], label: str = "binds", features: str = "vectors", max_iter: int = 100, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """The model of weights that were fitted in memory."""
    java = spark._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel
    model = MultilayerPerceptronClassificationModel(java(f"mlpc_{uuid.uuid4().hex[-12:]}", _py2java(spark.sparkContext, Vectors.dense(weights))))
    return model._set(layers=list(layers), labelCol=label, featuresCol=features, maxIter=max_iter, seed=seed)


def predict(df: DataFrame, model: Model, key: str = "id", keep: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    """``key, prediction, p1`` (and kept columns), by key if ``ordered``; an aggregate needs no order."""
    scored = model.transform(df)
    rows = scored.select(
        key, *keep, F.col("prediction").cast("double").alias("prediction"), class1_probability(scored).alias("p1")
    )
    return rows.orderBy(key) if ordered else rows


def save_model(model: Model, path: str) -> None:
    """Overwrite the model stored at ``path``."""
    model.write().overwrite().save(path)
