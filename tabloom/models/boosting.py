"""Boosted trees: gradient boosting with any loss, second-order boosting, AdaBoost.

The margin of a row is stored every CHECKPOINT_ROUNDS rounds in the shared folder; in
between, each task adds the outputs of the few trees grown since. So a round costs one
Spark job per tree level, and a lost executor costs at most that many trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import u01
from ..functions.vectors import stack
from ..session import compact, discard, materialize
from .base import LABEL, PREDICTION, SCORES, FittedModel, arg_best, as_array, register, width
from .trees import Batch, SplitRule, Tree, bin_edges, bin_rows, binned, grow, importance_of, unpack

CHECKPOINT_ROUNDS = 10


# ---- losses: numpy on one batch ------------------------------------------------------

def gradients(loss: str, y: np.ndarray, margin: np.ndarray, options: dict[str, float]) -> np.ndarray:
    """(outputs, rows, 2): gradient and curvature of the loss at the current margin."""
    if loss == "softmax":
        shifted = np.exp(margin - margin.max(axis=1, keepdims=True))
        p = shifted / shifted.sum(axis=1, keepdims=True)
        truth = np.arange(margin.shape[1]) == y[:, None]
        return np.stack([(p - truth).T, (p * (1.0 - p)).T], axis=2)
    m = margin[:, 0]
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-m))
        g, h = p - y, p * (1.0 - p)
        scale = np.where(y > 0, options.get("scale_pos_weight", 1.0), 1.0)
        g, h = g * scale, h * scale
    elif loss == "exponential":
        sign = 2.0 * y - 1.0
        e = np.exp(-sign * m)
        g, h = -sign * e, e
    elif loss == "absolute_error":
        g, h = -np.sign(y - m), np.ones(len(y))
    elif loss == "quantile":
        a = options["alpha"]
        g, h = np.where(y > m, -a, 1.0 - a), np.ones(len(y))
    elif loss == "huber":
        r, d = y - m, options["delta"]
        g, h = -np.where(np.abs(r) <= d, r, d * np.sign(r)), np.ones(len(y))
    else:
        g, h = m - y, np.ones(len(y))
    return np.stack([g, h], axis=1)[None]


def probabilities(loss: str, margin: np.ndarray) -> np.ndarray:
    if loss == "softmax":
        shifted = np.exp(margin - margin.max(axis=1, keepdims=True))
        return shifted / shifted.sum(axis=1, keepdims=True)
    scale = 2.0 if loss == "exponential" else 1.0
    p = 1.0 / (1.0 + np.exp(-scale * margin[:, 0]))
    return np.stack([1.0 - p, p], axis=1)


def add_trees(margin: np.ndarray, rounds: list[list[Tree]], rate: float, bins: np.ndarray) -> np.ndarray:
    out = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += rate * tree.output(bins)
    return out


# ---- stored form ----------------------------------------------------------------------

@register("boosted")
@dataclass
class BoostedModel(FittedModel):
    edges: list[list[float]]
    rounds: list[list[Tree]]
    start: list[float]
    rate: float
    loss: str

    @property
    def classifier(self) -> bool:
        return self.loss in ("softmax", "logistic", "exponential")

    def predict(self, df: DataFrame) -> DataFrame:
        edges, rounds, start, rate, loss = self.edges, self.rounds, self.start, self.rate, self.loss
        classifier = self.classifier

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            bins = bin_rows(stack(x), edges)
            margin = add_trees(np.tile(start, (len(bins), 1)), rounds, rate, bins)
            return pd.Series(list(probabilities(loss, margin) if classifier else margin))

        scored = df.withColumn(SCORES, outputs(as_array()))
        if classifier:
            return scored.withColumn(PREDICTION, arg_best(F.col(SCORES)))
        return scored.withColumn(PREDICTION, F.col(SCORES)[0]).drop(SCORES)

    @property
    def importances(self) -> np.ndarray:
        return importance_of([t for trees in self.rounds for t in trees], len(self.edges))

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        write_trees(spark, f"{path}/trees", self.rounds)
        return {"edges": self.edges, "start": self.start, "rate": self.rate, "loss": self.loss}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "BoostedModel":
        return cls(state["edges"], read_trees(spark, f"{path}/trees"), state["start"], state["rate"], state["loss"])


TREE_SCHEMA = (
    "round int, output int, feature array<int>, cut array<int>, left array<int>, right array<int>, "
    "gain array<double>, value array<double>"
)


def write_trees(spark: SparkSession, path: str, rounds: list[list[Tree]]) -> None:
    rows = [
        (r, k, t.feature, t.cut, t.left, t.right, [float(g) for g in t.gain], [float(v) for v in t.value])
        for r, trees in enumerate(rounds)
        for k, t in enumerate(trees)
    ]
    spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def read_trees(spark: SparkSession, path: str) -> list[list[Tree]]:
    rounds: dict[int, dict[int, Tree]] = {}
    for r in spark.read.schema(TREE_SCHEMA).parquet(path).collect():
        tree = Tree(r["feature"], r["cut"], r["left"], r["right"], r["gain"], [[] for _ in r["feature"]], r["value"])
        rounds.setdefault(r["round"], {})[r["output"]] = tree
    return [[trees[k] for k in sorted(trees)] for _, trees in sorted(rounds.items())]


# ---- fitting ----------------------------------------------------------------------------

def start_margin(train: DataFrame, loss: str, classes: int, options: dict[str, float]) -> list[float]:
    y = F.col(LABEL)
    if loss == "softmax":
        counts = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        return [float(np.log(max(counts.get(float(c), 0), 0.5) / total)) for c in range(classes)]
    if loss in ("logistic", "exponential"):
        share = min(max(train.agg(F.avg(y)).first()[0], 1e-6), 1 - 1e-6)
        odds = float(np.log(share / (1.0 - share)))
        return [odds if loss == "logistic" else odds / 2.0]
    if loss in ("absolute_error", "huber"):
        return [float(train.agg(F.percentile_approx(y, 0.5, 100_000)).first()[0])]
    if loss == "quantile":
        return [float(train.agg(F.percentile_approx(y, options["alpha"], 100_000)).first()[0])]
    return [float(train.agg(F.avg(y)).first()[0])]


@dataclass
class Settings:
    """The parameters of a boosted model, as numbers and rules."""

    second: bool
    rate: float
    depth: int
    rounds: int
    rule: SplitRule
    subsample: float
    keep: int
    features: int
    options: dict[str, float]
    picker: np.random.Generator

    @classmethod
    def of(cls, params: dict[str, Any], features: int) -> "Settings":
        second = params.get("order", 1) == 2
        rule = SplitRule(
            reg_lambda=float(params.get("reg_lambda", 1.0)) if second else 0.0,
            reg_alpha=float(params.get("reg_alpha", 0.0)) if second else 0.0,
            min_gain=float(params.get("gamma", 0.0)) if second else 0.0,
            min_weight=float(params.get("min_child_weight", 1.0)) if second else 0.0,
            min_leaf=int(params.get("min_samples_leaf", 1)),
            min_split=int(params.get("min_samples_split", 2)),
        )
        return cls(
            second=second,
            rate=float(params.get("learning_rate", 0.3 if second else 0.1)),
            depth=int(params.get("max_depth") or 6),
            rounds=int(params.get("n_estimators", 100)),
            rule=rule,
            subsample=float(params.get("subsample", 1.0)),
            keep=_feature_share(params.get("colsample_bytree") if second else params.get("max_features"), features),
            features=features,
            options={"alpha": float(params.get("alpha", 0.9)), "scale_pos_weight": float(params.get("scale_pos_weight", 1.0))},
            picker=np.random.default_rng(int(params.get("random_state", 42))),
        )

    def draw_features(self) -> list[int]:
        """The features of the next tree."""
        if self.keep >= self.features:
            return list(range(self.features))
        return sorted(self.picker.choice(self.features, self.keep, replace=False).tolist())


def sampling_number(number: int):
    """The uniform number of each row that decides its place in the sample of a round."""
    return u01("row_key", F.lit(number))


def set_newton_leaves(tree: Tree, rule: SplitRule) -> None:
    for leaf in tree.leaves():
        tree.value[leaf] = rule.leaf(tree.stats[leaf]) if tree.stats[leaf] else 0.0


def fit_boosted(train: DataFrame, params: dict[str, Any], loss: str, classes: int = 2) -> BoostedModel:
    """One tree per output and round on the gradient of the loss.

    `order` 2 uses the curvature in the splits and leaves; `order` 1 splits on the
    gradient alone and then sets each leaf by the rule of its loss.
    """
    features = width(train)
    own = Settings.of(params, features)
    options, rate = own.options, own.rate

    edges = bin_edges(train, features)
    start = start_margin(train, loss, classes, options)
    outputs = len(start)
    first = binned(train.select("row_key", LABEL, "features"), edges)
    rows = compact(materialize(first.withColumn("margin", F.lit(start).cast("array<double>")), "boosting"))
    rounds: list[list[Tree]] = []
    recent: list[list[Tree]] = []
    for number in range(own.rounds):
        use = own.draw_features()
        sampled = rows if own.subsample >= 1.0 else rows.where(sampling_number(number) < own.subsample)
        if loss == "huber":
            options["delta"] = _spread(sampled, features, recent, rate, options["alpha"])
        stats = _stats(loss, recent, rate, options, own.second)
        trees = grow(sampled, features, stats, 2, own.rule, own.depth, outputs, use)
        if own.second or loss == "squared_error":
            for tree in trees:
                set_newton_leaves(tree, own.rule)
        else:
            _set_leaves(sampled, features, trees, loss, recent, rate, options)
        rounds.append(trees)
        recent.append(trees)
        if len(recent) == CHECKPOINT_ROUNDS:
            before = rows
            rows = compact(materialize(_advance(rows, features, recent, rate), "boosting"))
            discard(before)
            recent = []
    discard(rows)
    return BoostedModel(edges, rounds, start, rate, loss)


def _feature_share(value, features: int) -> int:
    if value is None:
        return features
    if value == "sqrt":
        return max(1, int(features**0.5))
    if value == "log2":
        return max(1, int(np.log2(features))) if features > 1 else 1
    return max(1, int(float(value) * features))


def _stats(loss, recent, rate, options, second):
    recent, options = list(recent), dict(options)

    def stats_of(batch: Batch, bins: np.ndarray) -> np.ndarray:
        margin = add_trees(stack(batch["margin"]), recent, rate, bins)
        found = gradients(loss, batch["label"].to_numpy(), margin, options)
        if not second:
            found[:, :, 1] = 1.0
        return found

    return stats_of


def _advance(rows: DataFrame, features: int, recent, rate) -> DataFrame:
    recent = list(recent)

    @F.pandas_udf("array<double>")
    def moved(margin: pd.Series, bins: pd.Series) -> pd.Series:
        return pd.Series(list(add_trees(stack(margin), recent, rate, unpack(bins, features))))

    return rows.withColumn("margin", moved("margin", "bins"))


def _current(rows: DataFrame, features: int, recent, rate) -> DataFrame:
    """Rows with the margin as it is now."""
    return _advance(rows, features, recent, rate) if recent else rows


def _spread(rows, features, recent, rate, alpha) -> float:
    """The alpha quantile of the absolute residual, the corner of the Huber loss."""
    residual = F.abs(F.col(LABEL) - F.col("margin")[0])
    found = _current(rows, features, recent, rate).agg(F.percentile_approx(residual, alpha, 10_000)).first()[0]
    return float(found or 1e-12) or 1e-12


def _set_leaves(rows, features, trees, loss, recent, rate, options) -> None:
    """Leaf values by loss: a quantile of the residuals, or one Newton step.

    Tasks route whole batches. A quantile needs (leaf, residual) of each row, summarised by
    mergeable sketches; a Newton step needs the sums of a batch for each output and leaf only.
    """
    trees_now, outputs, options = list(trees), len(trees), dict(options)
    recent_now = list(recent)
    residuals = loss in ("absolute_error", "quantile", "huber")

    def placed(batches):
        for batch in map(Batch, batches):
            if not len(batch):
                continue
            codes, label = unpack(batch["bins"], features), batch[LABEL].to_numpy()
            now = add_trees(stack(batch["margin"]), recent_now, rate, codes)
            if residuals:
                leaf = trees_now[0].route(codes).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"output": np.zeros(len(leaf), np.int32), "leaf": leaf, "r": label - now[:, 0]})
                continue
            stats = gradients(loss, label, now, options)
            for k, tree in enumerate(trees_now):
                leaf = tree.route(codes)
                hit = np.unique(leaf)
                g, h = (np.bincount(leaf, stats[k, :, i])[hit] for i in range(2))
                frame = {"output": np.full(len(hit), k, np.int32), "leaf": hit.astype(np.int32), "g": g, "h": h}
                yield pa.RecordBatch.from_pydict(frame)

    schema = "output int, leaf int, " + ("r double" if residuals else "g double, h double")
    routed = rows.select(LABEL, "margin", "bins").mapInArrow(placed, schema)
    if loss == "huber":
        # The centre and the mean step from it are two passes over the same residuals.
        routed = materialize(routed, "residuals")
    grouped = routed.groupBy("output", "leaf")
    if residuals:
        at = options["alpha"] if loss == "quantile" else 0.5
        found = grouped.agg(F.percentile_approx("r", at, 10_000).alias("value"))
        if loss == "huber":
            centre = found.withColumnRenamed("value", "centre")
            off = F.col("r") - F.col("centre")
            step = F.signum(off) * F.least(F.abs(off), F.lit(options["delta"]))
            found = (
                routed.join(F.broadcast(centre), ["output", "leaf"])
                .groupBy("output", "leaf")
                .agg((F.first("centre") + F.avg(step)).alias("value"))
            )
    else:
        shrink = (outputs - 1) / outputs if outputs > 1 else 1.0
        found = grouped.agg((F.lit(-shrink) * F.sum("g") / F.greatest(F.sum("h"), F.lit(1e-12))).alias("value"))
    for row in found.collect():
        trees[row["output"]].value[row["leaf"]] = float(row["value"])
    if loss == "huber":
        discard(routed)
