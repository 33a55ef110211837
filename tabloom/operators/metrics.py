"""Metrics of a scored table (label, prediction[, score | scores]), optionally per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import quoted
from .running import running_totals


def _zero_safe(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def regression_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """mae, mse, rmse, r2 in one aggregation."""
    y, p = F.col("label").cast("double"), F.col("prediction").cast("double")
    sums = scored.groupBy(*map(quoted, by)).agg(
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.when(F.min(y) < F.max(y), F.var_pop(y)).alias("__var"),
    )
    return (
        sums.withColumn("rmse", F.sqrt("mse"))
        .withColumn("r2", F.when(F.col("__var") > 0, F.lit(1.0) - F.try_divide("mse", "__var")))
        .select(*map(quoted, by), "mae", "mse", "rmse", "r2")
    )


def confusion_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*map(quoted, by), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _class_table(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., class, support, predicted, hits) from the confusion counts."""
    pairs = confusion_counts(scored, by).select(
        *map(quoted, by),
        F.explode(
            F.array(
                F.struct(F.col("label").cast("double").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
                F.struct(F.col("prediction").cast("double").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")),
            )
        ).alias("e"),
        F.when(F.col("label").cast("double") == F.col("prediction").cast("double"), F.col("n")).otherwise(0).alias("both"),
    )
    return pairs.groupBy(*map(quoted, by), F.col("e.class").alias("class")).agg(
        F.sum("e.support").alias("support"),
        F.sum("e.predicted").alias("predicted"),
        F.sum(F.when(F.col("e.support") > 0, F.col("both")).otherwise(0)).alias("hits"),
    )


def binary_metrics(scored: DataFrame, by: Sequence[str] = (), positive: float = 1.0) -> DataFrame:
    """accuracy, precision, recall, f1 of the positive class; 0 where a ratio is undefined."""
    y, p = F.col("label") == positive, F.col("prediction") == positive
    sums = scored.groupBy(*map(quoted, by)).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.count_if(y & p).cast("double").alias("tp"),
        F.count_if(p).cast("double").alias("pp"),
        F.count_if(y).cast("double").alias("ap"),
    )
    return sums.select(
        *map(quoted, by),
        "accuracy",
        _zero_safe(F.lit(2.0) * F.col("tp"), F.col("pp") + F.col("ap")).alias("f1"),
        _zero_safe(F.col("tp"), F.col("pp")).alias("precision"),
        _zero_safe(F.col("tp"), F.col("ap")).alias("recall"),
    )


def weighted_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same four numbers, averaged over the classes by their support."""
    support, predicted, hits = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))
    total = F.sum(support)
    return (
        _class_table(scored, by)
        .groupBy(*map(quoted, by))
        .agg(
            (F.sum(hits) / total).alias("accuracy"),
            (F.sum(support * _zero_safe(F.lit(2.0) * hits, predicted + support)) / total).alias("f1"),
            (F.sum(support * _zero_safe(hits, predicted)) / total).alias("precision"),
            (F.sum(support * _zero_safe(hits, support)) / total).alias("recall"),
        )
    )


def score_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg): one row per distinct score."""
    positive = F.col("label").cast("double") == 1.0
    return scored.groupBy(*map(quoted, by), F.col("score").cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def roc_auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve, tied scores counted half; null without both classes."""
    ranked = running_totals(score_counts(scored, by), "score", {"negs": "neg"}, by)
    below = F.col("negs") - F.col("neg") * 0.5
    sums = ranked.groupBy(*map(quoted, by)).agg(
        F.sum(F.col("pos") * below).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n"))
    return sums.select(*map(quoted, by), area.alias("auc"))


def one_vs_rest_auc(scored: DataFrame, n_classes: int, by: Sequence[str] = (), scores: str = "scores") -> DataFrame:
    """Support-weighted mean of the per-class areas; `scores` is an array by class."""
    truth = F.col("label").cast("double")
    rows = scored.select(
        *map(quoted, by), truth.alias("__y"), F.posexplode(F.col(scores)).alias("class", "score")
    ).select(*map(quoted, by), "class", "score", (F.col("__y") == F.col("class")).cast("double").alias("label"))
    ranked = running_totals(score_counts(rows, [*by, "class"]), "score", {"negs": "neg"}, [*by, "class"])
    per_class = ranked.groupBy(*map(quoted, by), "class").agg(
        F.sum(F.col("pos") * (F.col("negs") - F.col("neg") * 0.5)).alias("wins"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    area = F.try_divide(F.col("wins"), F.col("p").cast("double") * F.col("n"))
    per_class = per_class.withColumn("auc", area).where(F.col("class") < n_classes)
    return per_class.groupBy(*map(quoted, by)).agg(
        (F.sum(F.col("auc") * F.col("p")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("p")))).alias("auc")
    )


