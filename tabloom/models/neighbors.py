"""k-nearest-neighbour models on the exact neighbour join."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbors import knn_join
from ..session import materialize
from .base import KEY, LABEL, PREDICTION, SCORES, FittedModel, arg_best, as_array, register


@register("neighbors")
@dataclass
class NeighborModel(FittedModel):
    rows: DataFrame
    k: int
    weights: str
    p: float
    classes: int  # 0 for regression

    def predict(self, df: DataFrame) -> DataFrame:
        # The answer depends on the vector alone, so equal vectors ask once.
        tagged = df.withColumn("__vector", as_array()).withColumn(
            "__key", F.md5(F.concat_ws(",", F.col("__vector").cast("array<string>")))
        )
        asked = tagged.groupBy("__key").agg(F.first("__vector").alias("vector"))
        near = knn_join(
            asked.withColumnRenamed("__key", "id"),
            self.rows.withColumnRenamed(KEY, "id"),
            self.k,
            self.p,
            payload=LABEL,
        )
        distance = F.col("distance")
        if self.weights == "distance":
            # An exact match takes all the weight.
            exact = F.min("distance") == 0
            weight = F.when(distance == 0, F.lit(1.0)).otherwise(F.lit(1.0) / distance)
            at_zero = F.when(distance == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            exact, weight, at_zero = F.lit(False), F.lit(1.0), F.lit(1.0)
        near = near.withColumns({"w": weight, "z": at_zero})
        if self.classes:
            shares = [
                F.when(exact, F.sum(F.when(F.col("payload") == c, F.col("z")).otherwise(0.0)) / F.sum("z")).otherwise(
                    F.sum(F.when(F.col("payload") == c, F.col("w")).otherwise(0.0)) / F.sum("w")
                )
                for c in range(self.classes)
            ]
            found = near.groupBy(F.col("query").alias("__key")).agg(F.array(*shares).alias(SCORES))
            found = found.withColumn(PREDICTION, arg_best(F.col(SCORES)))
        else:
            mean = F.when(exact, F.sum(F.col("payload") * F.col("z")) / F.sum("z")).otherwise(
                F.sum(F.col("payload") * F.col("w")) / F.sum("w")
            )
            found = near.groupBy(F.col("query").alias("__key")).agg(mean.alias(PREDICTION))
        return tagged.join(found, "__key").drop("__key", "__vector")

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        return {"k": self.k, "weights": self.weights, "p": self.p, "classes": self.classes}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "NeighborModel":
        rows = spark.read.parquet(f"{path}/rows")
        return cls(rows, state["k"], state["weights"], state["p"], state["classes"])


def fit_neighbors(train: DataFrame, params: dict[str, Any], classes: int) -> NeighborModel:
    metric = {"manhattan": 1, "euclidean": 2}.get(params.get("metric", "minkowski"), params.get("p", 2))
    rows = materialize(train.select(KEY, LABEL, as_array().alias("vector")), "neighbors")
    return NeighborModel(rows, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"), float(metric), classes)
