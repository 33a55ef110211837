"""AdaBoost: SAMME for classes, R2 for numbers, on histogram trees with row weights."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import stack
from ..session import compact, discard, materialize
from .base import LABEL, PREDICTION, SCORES, FittedModel, arg_best, as_array, register, width
from .boosting import CHECKPOINT_ROUNDS, read_trees, write_trees
from .trees import SplitRule, Tree, bin_edges, bin_rows, binned, grow, importance_of, unpack


@register("adaboost")
@dataclass
class AdaBoostModel(FittedModel):
    edges: list[list[float]]
    trees: list[Tree]
    votes: list[float]
    classes: int  # 0 for regression

    def predict(self, df: DataFrame) -> DataFrame:
        edges, trees, votes, classes = self.edges, self.trees, self.votes, self.classes

        @F.pandas_udf("array<double>")
        def outputs(x: pd.Series) -> pd.Series:
            bins = bin_rows(stack(x), edges)
            each = np.stack([t.output(bins) for t in trees], axis=1)
            if classes:
                return pd.Series(list(vote_shares(each, np.asarray(votes), classes)))
            return pd.Series(list(weighted_median(each, np.asarray(votes))[:, None]))

        scored = df.withColumn(SCORES, outputs(as_array()))
        if classes:
            return scored.withColumn(PREDICTION, arg_best(F.col(SCORES)))
        return scored.withColumn(PREDICTION, F.col(SCORES)[0]).drop(SCORES)

    @property
    def importances(self) -> np.ndarray:
        total = np.zeros(len(self.edges))
        for tree, vote in zip(self.trees, self.votes):
            total += vote * importance_of([tree], len(self.edges))
        return total / total.sum() if total.sum() > 0 else total

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        write_trees(spark, f"{path}/trees", [[t] for t in self.trees])
        return {"edges": self.edges, "votes": self.votes, "classes": self.classes}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "AdaBoostModel":
        trees = [r[0] for r in read_trees(spark, f"{path}/trees")]
        return cls(state["edges"], trees, state["votes"], state["classes"])


def vote_shares(each: np.ndarray, votes: np.ndarray, classes: int) -> np.ndarray:
    """Probabilities from the weighted vote: softmax of the centred vote, as SAMME defines it."""
    tally = np.stack([(each == c) @ votes for c in range(classes)], axis=1) / votes.sum()
    decision = tally - (1.0 - tally) / (classes - 1)
    if classes == 2:
        score = np.exp(decision[:, 1] - decision[:, 0])
        p = score / (1.0 + score)
        return np.stack([1.0 - p, p], axis=1)
    raised = np.exp(decision / (classes - 1))
    return raised / raised.sum(axis=1, keepdims=True)


def weighted_median(each: np.ndarray, votes: np.ndarray) -> np.ndarray:
    order = np.argsort(each, axis=1, kind="stable")
    running = np.cumsum(votes[order], axis=1)
    place = (running >= 0.5 * running[:, -1:]).argmax(axis=1)
    rows = np.arange(len(each))
    return each[rows, order[rows, place]]


def fit_samme(train: DataFrame, params: dict[str, Any], classes: int) -> AdaBoostModel:
    """Stumps on class weights; the error of a stump is read off its own histogram."""
    features, edges, rows = _setup(train)
    rate = float(params.get("learning_rate", 1.0))
    trees: list[Tree] = []
    votes: list[float] = []
    recent: list[tuple[Tree, float]] = []
    for _ in range(int(params.get("n_estimators", 50))):
        known = list(recent)

        def stats_of(batch: pd.DataFrame, bins: np.ndarray, known=known) -> np.ndarray:
            label = batch["label"].to_numpy()
            weight = misses(batch["weight"].to_numpy(), label, bins, known)
            return ((np.arange(classes) == label[:, None]) * weight[:, None])[None]

        tree = grow(rows, features, stats_of, classes, SplitRule("gini"), int(params.get("max_depth", 1)))[0]
        total = sum(tree.stats[0])
        wrong = 0.0
        for leaf in tree.leaves():
            stats = tree.stats[leaf]
            tree.value[leaf] = float(int(np.argmax(stats)))
            wrong += sum(stats) - max(stats)
        error = wrong / total if total > 0 else 0.0
        if error <= 1e-12:
            trees.append(tree)
            votes.append(1.0)
            break
        if error >= 1.0 - 1.0 / classes:
            if not trees:
                trees.append(tree)
                votes.append(1.0)
            break
        vote = rate * (float(np.log((1.0 - error) / error)) + float(np.log(classes - 1.0)))
        trees.append(tree)
        votes.append(vote)
        recent.append((tree, vote))
        if len(recent) == CHECKPOINT_ROUNDS:
            before = rows
            rows, recent = _reweighted(rows, features, recent), []
            discard(before)
    discard(rows)
    return AdaBoostModel(edges, trees, votes, classes)


def misses(weight: np.ndarray, label: np.ndarray, bins: np.ndarray, known: list[tuple[Tree, float]]) -> np.ndarray:
    power = np.zeros(len(label))
    for tree, vote in known:
        power += vote * (tree.output(bins) != label)
    return weight * np.exp(power)


def _setup(train: DataFrame):
    features = width(train)
    edges = bin_edges(train, features)
    rows = binned(train.select("row_key", LABEL, "features"), edges)
    return features, edges, compact(materialize(rows.withColumn("weight", F.lit(1.0)), "adaboost"))


def _reweighted(rows: DataFrame, features: int, recent: list[tuple[Tree, float]]) -> DataFrame:
    """Fold the recent stumps into the stored weights, scaled to a mean of one."""
    known = list(recent)

    @F.pandas_udf("double")
    def moved(weight: pd.Series, label: pd.Series, bins: pd.Series) -> pd.Series:
        return pd.Series(misses(weight.to_numpy(), label.to_numpy(), unpack(bins, features), known))

    return _scaled(rows.withColumn("weight", moved("weight", LABEL, "bins")))


def _scaled(rows: DataFrame) -> DataFrame:
    held = compact(materialize(rows, "adaboost"))
    mean = held.agg(F.avg("weight")).first()[0] or 1.0
    return held.withColumn("weight", F.col("weight") / F.lit(mean))


def fit_r2(train: DataFrame, params: dict[str, Any]) -> AdaBoostModel:
    """Depth-3 trees on weighted rows; weights follow the relative error of each round."""
    features, edges, rows = _setup(train)
    rate, loss = float(params.get("learning_rate", 1.0)), params.get("loss", "linear")
    rule = SplitRule("newton")
    trees: list[Tree] = []
    votes: list[float] = []
    recent: list[tuple[Tree, float, float]] = []
    for _ in range(int(params.get("n_estimators", 50))):
        known = list(recent)

        def stats_of(batch: pd.DataFrame, bins: np.ndarray, known=known) -> np.ndarray:
            label = batch["label"].to_numpy()
            weight = _discounted(batch["weight"].to_numpy(), label, bins, known, loss, rate)
            return np.stack([-weight * label, weight], axis=1)[None]

        tree = grow(rows, features, stats_of, 2, rule, int(params.get("max_depth", 3)))[0]
        for leaf in tree.leaves():
            tree.value[leaf] = rule.leaf(tree.stats[leaf])

        measured = rows.select(_errors(tree, known, features, loss, rate)("weight", LABEL, "bins").alias("m")).select("m.*")
        sums = measured.agg(
            F.max(F.when(F.col("w") > 0, F.col("e"))).alias("top"),
            F.sum("w").alias("w"),
            F.sum(F.col("w") * F.col("e")).alias("we"),
            F.sum(F.col("w") * F.col("e") * F.col("e")).alias("wee"),
        ).first()
        top = sums["top"] or 0.0
        if top <= 0:
            trees.append(tree)
            votes.append(1.0)
            break
        if loss == "linear":
            average = sums["we"] / (top * sums["w"])
        elif loss == "square":
            average = sums["wee"] / (top * top * sums["w"])
        else:
            average = measured.agg(F.sum(F.col("w") * (1.0 - F.exp(-F.col("e") / top)))).first()[0] / sums["w"]
        if average >= 0.5:
            if not trees:
                trees.append(tree)
                votes.append(1.0)
            break
        beta = average / (1.0 - average)
        trees.append(tree)
        votes.append(rate * float(np.log(1.0 / beta)))
        recent.append((tree, top, beta))
        if len(recent) == CHECKPOINT_ROUNDS:
            before = rows
            rows, recent = _scaled(_discount_rows(rows, features, recent, loss, rate)), []
            discard(before)
    discard(rows)
    return AdaBoostModel(edges, trees, votes, 0)


def _errors(tree: Tree, known, features: int, loss: str, rate: float):
    @F.pandas_udf("w double, e double")
    def errors(weight: pd.Series, label: pd.Series, bins: pd.Series) -> pd.DataFrame:
        codes, y = unpack(bins, features), label.to_numpy()
        w = _discounted(weight.to_numpy(), y, codes, known, loss, rate)
        return pd.DataFrame({"w": w, "e": np.abs(y - tree.output(codes))})

    return errors


def _discounted(weight, label, bins, known, loss, rate) -> np.ndarray:
    power = np.zeros(len(label))
    for tree, top, beta in known:
        share = np.minimum(np.abs(label - tree.output(bins)) / top, 1.0)
        if loss == "square":
            share = share * share
        elif loss == "exponential":
            share = 1.0 - np.exp(-share)
        power += rate * (1.0 - share) * np.log(beta)
    return weight * np.exp(power)


def _discount_rows(rows: DataFrame, features: int, recent, loss, rate) -> DataFrame:
    known = list(recent)

    @F.pandas_udf("double")
    def moved(weight: pd.Series, label: pd.Series, bins: pd.Series) -> pd.Series:
        return pd.Series(_discounted(weight.to_numpy(), label.to_numpy(), unpack(bins, features), known, loss, rate))

    return rows.withColumn("weight", moved("weight", LABEL, "bins"))
