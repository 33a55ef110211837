"""What every fitted model offers, and how it is stored.

Training tables have the columns (row_key, label, features): a text key, a double and a
vector. `predict` adds `prediction`, and for classifiers `scores`, an array with one
probability per class.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, LABEL, FEATURES, PREDICTION, SCORES = "row_key", "label", "features", "prediction", "scores"

_KINDS: dict[str, type] = {}


def register(kind: str):
    def add(cls: type) -> type:
        cls.kind = kind
        _KINDS[kind] = cls
        return cls

    return add


class FittedModel:
    """Subclasses define `predict`, `store` and `restore`."""

    kind = ""

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    @property
    def importances(self) -> np.ndarray | None:
        return None

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        raise NotImplementedError

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"kind": self.kind, **self.store(spark, path)}
        write_json(spark, f"{path}/meta", state)


def load_model(spark: SparkSession, path: str) -> FittedModel:
    state = read_json(spark, f"{path}/meta")
    return _KINDS[state["kind"]].restore(spark, path, state)


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    text = json.dumps(value, default=_plain)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _plain(value):
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    raise TypeError(type(value))


def as_array(column: str = FEATURES) -> Column:
    return vector_to_array(F.col(column))


def width(df: DataFrame) -> int:
    """Number of features."""
    row = df.select(F.size(as_array()).alias("n")).first()
    return row["n"] if row else 0


def arg_best(scores: Column) -> Column:
    """Class with the largest score, the smallest class on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")
