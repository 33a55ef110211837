"""Least squares with non-negative coefficients, from the Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import stack
from .base import LABEL, PREDICTION, FittedModel, as_array, register, width


@register("linear")
@dataclass
class LinearModel(FittedModel):
    weights: list[float]
    intercept: float

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, dot(as_array(), self.weights) + F.lit(self.intercept))

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        return {"weights": self.weights, "intercept": self.intercept}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "LinearModel":
        return cls(state["weights"], state["intercept"])


def dot(array, weights):
    products = F.zip_with(array, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def gram(df: DataFrame, size: int) -> np.ndarray:
    """Z'Z of z = (features, 1, label): one partial matrix per task, summed by cell."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 2, size + 2))
        for batch in batches:
            z = np.column_stack([stack(batch["x"]), np.ones(len(batch)), batch["label"]]) if len(batch) else np.zeros((0, size + 2))
            total += z.T @ z
        i, j = np.triu_indices(size + 2)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    cells = df.select(as_array().alias("x"), F.col(LABEL).cast("double").alias("label")).mapInPandas(partial, "i int, j int, v double")
    out = np.zeros((size + 2, size + 2))
    for row in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"]
    return out


def fit_nonnegative(train: DataFrame, params: dict[str, Any]) -> LinearModel:
    """Coordinate descent on the normal equations; the intercept is free."""
    size = width(train)
    z = gram(train, size)
    n = z[size, size]
    a, b = z[:size, :size], z[:size, size + 1]
    if params.get("fit_intercept", True):
        mean, centre = z[:size, size] / n, z[size, size + 1] / n
        a, b = a - n * np.outer(mean, mean), b - n * mean * centre
    w = np.zeros(size)
    for _ in range(10_000):
        before = w.copy()
        for j in range(size):
            if a[j, j] > 1e-12:
                w[j] = max(0.0, w[j] + (b[j] - a[j] @ w) / a[j, j])
        if np.abs(w - before).max(initial=0.0) < 1e-12:
            break
    intercept = float(centre - mean @ w) if params.get("fit_intercept", True) else 0.0
    return LinearModel(w.tolist(), intercept)
