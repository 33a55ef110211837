"""Models that Spark ML fits itself: trees, forests, gradient boosting, linear models."""

from __future__ import annotations

from math import ceil
from typing import Any

import numpy as np
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.encode import class_weights
from .base import FEATURES, LABEL, PREDICTION, SCORES, FittedModel, register
from .class_trees import fit_deep_tree

# The deepest tree that Spark ML grows; it stands for "no limit".
MAX_DEPTH = 30
# Cut points looked at per feature, unless `max_bins` says otherwise.
MAX_BINS = 128
# Deeper trees keep each row's node, else every task of every level gets all nodes that there are.
SHALLOW = 10


@register("native")
class NativeModel(FittedModel):
    def __init__(self, model, classifier: bool):
        self.model, self.classifier = model, classifier

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(df)
        if not self.classifier:
            return scored
        return scored.withColumn(SCORES, vector_to_array(F.col("probability"))).drop("rawPrediction", "probability")

    @property
    def importances(self) -> np.ndarray | None:
        found = getattr(self.model, "featureImportances", None)
        return None if found is None else found.toArray()

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        self.model.write().overwrite().save(f"{path}/native")
        return {"class": type(self.model).__name__, "classifier": self.classifier}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "NativeModel":
        module = C if hasattr(C, state["class"]) else R
        return cls(getattr(module, state["class"]).load(f"{path}/native"), state["classifier"])


def _tree_options(params: dict[str, Any]) -> dict[str, Any]:
    depth = MAX_DEPTH if params.get("max_depth") is None else min(MAX_DEPTH, int(params["max_depth"]))
    leaf = max(int(params.get("min_samples_leaf", 1)), ceil(params.get("min_samples_split", 2) / 2))
    return {
        "maxDepth": depth,
        "cacheNodeIds": depth > SHALLOW,
        "minInstancesPerNode": leaf,
        "maxBins": int(params.get("max_bins", MAX_BINS)),
        "seed": int(params.get("random_state", 42)),
    }


def subset_strategy(value) -> str:
    if value is None or value == 1.0:
        return "all"
    return value if isinstance(value, str) else str(float(value))


def _impurity(params: dict[str, Any]) -> str:
    return "gini" if params.get("criterion", "gini") == "gini" else "entropy"


def _columns(estimator):
    return estimator.setFeaturesCol(FEATURES).setLabelCol(LABEL).setPredictionCol(PREDICTION)


def _weighted(train: DataFrame, params: dict[str, Any], estimator):
    if params.get("class_weight") is None:
        return train, estimator
    return class_weights(train, LABEL, "weight"), estimator.setWeightCol("weight")


def fit_tree(train: DataFrame, params: dict[str, Any], classifier: bool) -> NativeModel:
    """A single tree; a random feature subset needs the one-tree forest."""
    options = _tree_options(params)
    subset = subset_strategy(params.get("max_features"))
    kind = {"impurity": _impurity(params)} if classifier else {}
    if subset == "all":
        estimator = (C.DecisionTreeClassifier if classifier else R.DecisionTreeRegressor)(**options, **kind)
    else:
        forest = C.RandomForestClassifier if classifier else R.RandomForestRegressor
        estimator = forest(numTrees=1, bootstrap=False, featureSubsetStrategy=subset, **options, **kind)
    estimator, balanced = _columns(estimator), classifier and params.get("class_weight") is not None
    if classifier and kind["impurity"] == "gini" and options["maxDepth"] > SHALLOW:
        found = fit_deep_tree(train, estimator.setWeightCol("weight") if balanced else estimator, balanced)
        if found is not None:
            return NativeModel(found, classifier)
    train, estimator = _weighted(train, params if classifier else {}, estimator)
    return NativeModel(estimator.fit(train), classifier)


def fit_forest(train: DataFrame, params: dict[str, Any], classifier: bool) -> NativeModel:
    options = _tree_options(params)
    forest = C.RandomForestClassifier if classifier else R.RandomForestRegressor
    estimator = forest(
        numTrees=int(params.get("n_estimators", 100)),
        bootstrap=bool(params.get("bootstrap", True)),
        featureSubsetStrategy=subset_strategy(params.get("max_features", "sqrt" if classifier else None)),
        **options,
        **({"impurity": _impurity(params)} if classifier else {}),
    )
    train, estimator = _weighted(train, params if classifier else {}, _columns(estimator))
    return NativeModel(estimator.fit(train), classifier)


def fit_gbt(train: DataFrame, params: dict[str, Any], classifier: bool) -> NativeModel:
    """Squared loss, or log loss of two classes."""
    boosted = C.GBTClassifier if classifier else R.GBTRegressor
    options = _tree_options({"max_depth": 3, **params})
    estimator = boosted(
        maxIter=int(params.get("n_estimators", 100)),
        stepSize=float(params.get("learning_rate", 0.1)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=subset_strategy(params.get("max_features")),
        **options,
    )
    return NativeModel(_columns(estimator).fit(train), classifier)


def fit_logistic(train: DataFrame, params: dict[str, Any]) -> NativeModel:
    """L2 penalty with the strength 1/C on the summed loss."""
    rows = train.count()
    estimator = C.LogisticRegression(
        regParam=1.0 / (float(params.get("C", 1.0)) * max(rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=int(params.get("max_iter", 100)),
    )
    train, estimator = _weighted(train, params, _columns(estimator))
    return NativeModel(estimator.fit(train), True)


def fit_linear(train: DataFrame, params: dict[str, Any]) -> NativeModel:
    estimator = R.LinearRegression(
        # Normal equations up to 4,096 features, gradients beyond: the same minimum.
        regParam=0.0, solver="auto", maxIter=1000, tol=1e-12, fitIntercept=params.get("fit_intercept", True)
    )
    return NativeModel(_columns(estimator).fit(train), False)


def _label_spread(train: DataFrame) -> tuple[int, float]:
    flat = F.min(LABEL) == F.max(LABEL)
    row = train.agg(F.count(LABEL).alias("n"), F.when(flat, 0.0).otherwise(F.stddev_samp(LABEL)).alias("s")).first()
    return row["n"], row["s"] or 1.0


def fit_ridge(train: DataFrame, params: dict[str, Any]) -> NativeModel:
    """Penalty alpha on the summed squares; Spark divides its L2 term by the label's deviation."""
    rows, spread = _label_spread(train)
    estimator = R.LinearRegression(
        regParam=float(params.get("alpha", 1.0)) * spread / rows,
        elasticNetParam=0.0,
        standardization=False,
        solver="l-bfgs",
        maxIter=200,
        tol=1e-9,
        fitIntercept=params.get("fit_intercept", True),
    )
    return NativeModel(_columns(estimator).fit(train), False)


def fit_elastic(train: DataFrame, params: dict[str, Any], ratio: float) -> NativeModel:
    """L1 share `ratio` of alpha; ratio 1 is the lasso."""
    _, spread = _label_spread(train)
    alpha = float(params.get("alpha", 1.0))
    first, second = alpha * ratio, alpha * (1.0 - ratio) * spread
    estimator = R.LinearRegression(
        regParam=first + second,
        elasticNetParam=first / (first + second),
        standardization=False,
        solver="l-bfgs",
        maxIter=int(params.get("max_iter", 500)),
        tol=1e-9,
    )
    return NativeModel(_columns(estimator).fit(train), False)
