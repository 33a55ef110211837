"""A regression tree by absolute error or by Poisson deviance.

Poisson deviance needs the sums that the histogram trees gather anyway. Absolute error does not
follow from sums: each (node, feature, bin) keeps the number and the sum of its labels by label
level, a summary that adds up over tasks. A level is one distinct label, if there are at most
`LEVELS`, and otherwise the labels between two quantiles. From the levels of a prefix of bins
follow its median and its summed distances to it; between quantiles the rows of the level that
holds the median count as equal to their mean, so a split's error is off by at most the width of
that level for each row in it. Leaves predict the exact median: the levels name the one that holds
it, and only the labels of that level are ranked.

A (node, feature) has at most bins x levels rows and is judged in one task; the driver sees one
row per open node. A random subset of features is drawn once for the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import compact, discard, materialize
from .base import LABEL, width
from .boosting import BoostedModel, _feature_share
from .trees import BINS, SplitRule, Tree, bin_edges, binned, grow, unpack

LEVELS = 256
#: Stands for "no limit", as in the trees that Spark ML grows.
MAX_DEPTH = 30


def label_levels(train: DataFrame, levels: int) -> list[float]:
    """Upper ends of the label levels."""
    distinct = train.select(LABEL).distinct().limit(levels + 1).collect()
    if len(distinct) <= levels:
        return sorted(r[LABEL] for r in distinct)
    probs = [i / levels for i in range(1, levels + 1)]
    cuts = train.agg(F.percentile_approx(LABEL, probs, 10_000)).first()[0]
    return sorted(set(cuts))


def distances(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Summed distances to the median, for each row of label levels."""
    below, rows = np.cumsum(counts, axis=1), np.arange(len(counts))
    below_sum = np.cumsum(sums, axis=1)
    total, whole = below[:, -1], below_sum[:, -1]
    at = np.argmax(2 * below >= total[:, None], axis=1)
    held, held_sum = counts[rows, at], sums[rows, at]
    median = np.divide(held_sum, held, out=np.zeros(len(counts)), where=held > 0)
    n_low, low = below[rows, at] - held, below_sum[rows, at] - held_sum
    n_high, high = total - below[rows, at], whole - below_sum[rows, at]
    return median * n_low - low + high - median * n_high


def _best_cut(levels: int, min_leaf: int):
    def run(table: pa.Table) -> pa.Table:
        bins, level = table.column("bin").to_numpy(), table.column("level").to_numpy()
        counts, sums = np.zeros((BINS, levels)), np.zeros((BINS, levels))
        counts[bins, level], sums[bins, level] = table.column("n").to_numpy(), table.column("total").to_numpy()
        left, left_sum = np.cumsum(counts, axis=0), np.cumsum(sums, axis=0)
        n, n_left = left[-1].sum(), left.sum(axis=1)
        gain = distances(left[-1:], left_sum[-1:]) - distances(left, left_sum) - distances(left[-1] - left, left_sum[-1] - left_sum)
        gain[(n_left < min_leaf) | (n - n_left < min_leaf)] = -np.inf
        cut = int(np.argmax(gain))
        found = {"node": table.column("node")[:1], "feature": table.column("feature")[:1]}
        return pa.table({**found, "cut": pa.array([cut], pa.int32()), "gain": [float(gain[cut])], "n": pa.array([int(n)], pa.int64())})

    return run


def _summaries(features: int, used: list[int], tree: Tree, nodes: list[int], ends: list[float]):
    """Rows (node, feature, bin, level, n, total) of a task, added up within each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.full(len(tree.feature), -1, dtype=np.int64)
        slots[nodes] = np.arange(len(nodes))
        for batch in batches:
            bins, y = unpack(batch["bins"], features), batch[LABEL].to_numpy()
            slot = slots[tree.route(bins)]
            inside = slot >= 0
            level = np.minimum(np.searchsorted(ends, y[inside]), len(ends) - 1)
            place = slot[inside][:, None] * len(used) + np.arange(len(used))
            cell = ((place * BINS + bins[inside][:, used]) * len(ends) + level[:, None]).ravel()
            found, row, n = np.unique(cell, return_inverse=True, return_counts=True)
            total = np.bincount(row.ravel(), weights=np.repeat(y[inside], len(used)), minlength=len(found))
            rest, level = np.divmod(found, len(ends))
            rest, cut = np.divmod(rest, BINS)
            slot, feature = np.divmod(rest, len(used))
            yield pd.DataFrame({
                "node": np.array(nodes)[slot].astype(np.int32), "feature": np.array(used)[feature].astype(np.int32),
                "bin": cut.astype(np.int32), "level": level.astype(np.int32), "n": n.astype(np.int64), "total": total,
            })

    return run


def _place_of(features: int, tree: Tree, ends: list[float]):
    @F.pandas_udf("leaf int, level int")
    def place(bins: pd.Series, label: pd.Series) -> pd.DataFrame:
        leaf = tree.route(unpack(bins, features)).astype(np.int32)
        level = np.minimum(np.searchsorted(ends, label.to_numpy()), len(ends) - 1)
        return pd.DataFrame({"leaf": leaf, "level": level.astype(np.int32)})

    return place


def leaf_medians(rows: DataFrame, features: int, tree: Tree, ends: list[float]) -> DataFrame:
    """(leaf, value): the exact median of each leaf, the mean of the middle two of an even number."""
    place = _place_of(features, tree, ends)("bins", LABEL).alias("p")
    # (leaf, level, label, n) is at most one row for each distinct label of a leaf.
    counted = rows.select(place, LABEL).groupBy("p.leaf", "p.level", LABEL).agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted, "labels")
    to_here = Window.partitionBy("leaf").orderBy("level")
    held = counted.groupBy("leaf", "level").agg(F.sum("n").alias("held"))
    held = held.withColumn("below", F.sum("held").over(to_here) - F.col("held"))
    held = held.withColumn("all", F.sum("held").over(Window.partitionBy("leaf")))
    low, high = F.expr("(all - 1) div 2"), F.expr("all div 2")
    inside = lambda rank, n: (F.col("below") <= rank) & (rank < F.col("below") + F.col(n))
    levels = held.where(inside(low, "held") | inside(high, "held"))
    ranked = counted.join(levels, ["leaf", "level"])
    before = F.sum("n").over(Window.partitionBy("leaf", "level").orderBy(LABEL)) - F.col("n")
    ranked = ranked.withColumn("below", F.col("below") + before)
    first, last = F.min(F.when(inside(low, "n"), F.col(LABEL))), F.min(F.when(inside(high, "n"), F.col(LABEL)))
    return ranked.groupBy("leaf").agg(((first + last) / 2).alias("value"))


def grow_absolute(rows: DataFrame, features: int, used: list[int], rule: SplitRule, depth: int, levels: int = LEVELS) -> Tree:
    """One tree that lowers the summed distances to the medians, level by level."""
    ends = label_levels(rows, levels)
    tree, nodes = Tree(), [0] if ends and used else []
    for _ in range(depth):
        if not nodes:
            break
        cells = rows.select(LABEL, "bins").mapInPandas(
            _summaries(features, used, tree, nodes, ends), "node int, feature int, bin int, level int, n long, total double"
        )
        keys = ["node", "feature"]
        merged = cells.groupBy(*keys, "bin", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        cuts = merged.groupBy(*keys).applyInArrow(
            _best_cut(len(ends), max(1, rule.min_leaf)), "node int, feature int, cut int, gain double, n long"
        )
        best = F.max_by(F.struct("feature", "cut", "gain", "n"), F.struct("gain", -F.col("feature"))).alias("best")
        nodes_next = []
        for row in cuts.groupBy("node").agg(best).select("node", "best.*").orderBy("node").collect():
            if row["n"] >= rule.min_split and np.isfinite(row["gain"]) and row["gain"] > 1e-9:
                nodes_next += tree.split(row["node"], row["feature"], row["cut"], row["gain"], [], [])
        nodes = nodes_next
    if ends:
        for row in leaf_medians(rows, features, tree, ends).collect():
            tree.value[row["leaf"]] = row["value"]
    return tree


def grow_poisson(rows: DataFrame, features: int, used: list[int], rule: SplitRule, depth: int) -> Tree:
    """One tree that lowers the Poisson deviance; every leaf has a positive mean, the root's aside."""
    least, total, n = rows.agg(F.min(LABEL), F.sum(LABEL), F.count(F.lit(1))).first()
    if n and (least < 0 or total <= 0):
        raise ValueError("the Poisson deviance needs labels of at least 0 and a positive sum")

    def sums(batch: pd.DataFrame, bins: np.ndarray) -> np.ndarray:
        y = batch[LABEL].to_numpy()
        return np.stack([-y, np.ones(len(y))], axis=1)[None]

    tree = grow(rows, features, sums, 2, rule, depth, 1, used)[0]
    for leaf in tree.leaves():
        tree.value[leaf] = rule.leaf(tree.stats[leaf]) if tree.stats[leaf] else (total or 0.0) / max(n, 1)
    return tree


def fit_criterion_tree(train: DataFrame, params: dict[str, Any], criterion: str) -> BoostedModel:
    """`criterion` is absolute_error or poisson. Empty training rows give a tree that predicts 0."""
    features = width(train)
    edges = bin_edges(train, features)
    rows = compact(materialize(binned(train.select("row_key", LABEL, "features"), edges), "criterion"))
    depth = MAX_DEPTH if params.get("max_depth") is None else min(MAX_DEPTH, int(params["max_depth"]))
    rule = SplitRule(
        "poisson" if criterion == "poisson" else "absolute",
        min_leaf=int(params.get("min_samples_leaf", 1)), min_split=int(params.get("min_samples_split", 2)),
    )
    share = params.get("max_features")
    some = _feature_share(None if share == 1.0 else share, features)
    drawn = np.random.default_rng(int(params.get("random_state", 42))).choice(features, some, replace=False) if features else []
    grown = grow_poisson if criterion == "poisson" else grow_absolute
    tree = grown(rows, features, sorted(int(j) for j in drawn), rule, depth)
    discard(rows)
    return BoostedModel(edges, [[tree]], [0.0], 1.0, "squared_error")
