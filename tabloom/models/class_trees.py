"""One deep classification tree (gini): the tree of Spark ML in few and light passes.

Spark ML keeps each row as objects, which spill to disk and come back for each level where memory is
short. A level's pass is repeated where its histograms exceed a limit, and each task sends those of all
open nodes: a tree without a depth limit has open nodes in proportion to the rows, so that grows with
their square. Here

1. the cut points are Spark ML's, from the same sampled rows, and rows become a byte a feature;
2. large nodes are split level by level from histograms that tasks add up;
3. the rows of nodes of at most `LOCAL_ROWS` rows go to one task each, several nodes to a task, and it
   finishes their subtrees. So there are at most rows / `LOCAL_ROWS` large nodes.

A random feature subset is drawn for each node in the order in which Spark ML reaches the nodes, level
after level, so such a tree has no step 3 and a limited depth. Counts are whole numbers and gains are
computed in Spark ML's order, so the nodes are the same, and the result is a Spark ML model. It does not depend on `LOCAL_ROWS` or `UNIT_ROWS`.
Class weights that are not whole numbers make equal gains differ by rounding in Spark ML; here the first wins.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from math import ceil, log, prod

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import list_matrix
from ..session import discard, materialize, remove, scratch_path
from .base import FEATURES, LABEL, as_array, width
from .trees import bin_rows

LOCAL_ROWS = 500_000
# Small nodes are dealt to tasks in groups of about so many rows.
UNIT_ROWS = 50_000
# Cells of the histograms that a task holds at once.
CELLS = 1 << 20
MAX_FEATURES = 256
# Cells that are counted at once, and nodes whose histograms are summed by one call.
COUNTED, NODES = 1 << 21, 64
# Deeper trees by feature subsets have too many open nodes for this, and fewer rows fit Spark ML's memory.
SUBSET_DEPTH, SUBSET_ROWS = 16, 2_000_000
# Rows that Spark ML samples at least for cut points.
SAMPLED = 10_000
EPSILON = 2.0**-52
MASK32, MASK48, MASK64 = (1 << 32) - 1, (1 << 48) - 1, (1 << 64) - 1
INTS, FLOATS = np.int64, np.float64
COLUMNS = {"feature": INTS, "cut": INTS, "left": INTS, "right": INTS, "depth": INTS, "gain": FLOATS, "counts": FLOATS}
GROWN = "roots binary, " + ", ".join(f"{name} binary" for name in COLUMNS)


def fit_deep_tree(train: DataFrame, estimator, balanced: bool = False):
    """The model that `estimator.fit(train)` gives; None if this way of growing it does not apply.

    The estimator is a tree or a forest of one tree without bootstrap. `balanced` weighs the classes alike.
    """
    by_class = {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_class) < 2 or any(c is None or c < 0 or c != int(c) for c in by_class):
        return None
    counts = np.zeros(int(max(by_class)) + 1)
    for c, n in by_class.items():
        counts[int(c)] = n
    total = int(counts.sum())
    weights = np.array([float(total) / (n * len(by_class)) if balanced and n else 1.0 for n in counts])
    features, bins = width(train), min(estimator.getMaxBins(), total)
    if not 0 < features <= MAX_FEATURES or bins > 255 or len(counts) > 256 or features * bins * len(counts) > 4 * CELLS:
        return None
    each = subset_size(estimator, features)
    if each < features and (estimator.getMaxDepth() > SUBSET_DEPTH or total < SUBSET_ROWS):
        return None
    edges = cut_points(train, features, total, bins, estimator.getSeed(), weights)
    rows = materialize(binned(train, edges), "binned")
    draws = Draws(features, each, estimator.getSeed()) if each < features else None
    sizes = [len(e) + 1 for e in edges]
    tree = grow(rows, counts, sizes, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), weights, draws)
    discard(rows)
    return spark_model(train.sparkSession, tree, edges, estimator)


def subset_size(estimator, features: int) -> int:
    """Features that Spark ML looks at for a node."""
    if isinstance(estimator, C.DecisionTreeClassifier):
        return features
    match estimator.getFeatureSubsetStrategy():
        case "all" | "auto":
            return features
        case "sqrt":
            return ceil(features**0.5)
        case "log2":
            return max(1, ceil(log(features) / log(2)))
        case "onethird":
            return ceil(features / 3.0)
        case text:
            return min(int(text), features) if text.isdigit() else ceil(float(text) * features)


class Draws:
    """The feature subsets of Spark ML: a seed for each node, and a reservoir of the features by it."""

    def __init__(self, features: int, each: int, seed: int):
        self.features, self.each = features, each
        self.state = (seed ^ 0x5DEECE66D) & MASK48

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & MASK48
        return self.state >> 16

    def take(self, nodes: int) -> np.ndarray:
        """(node, place): features in the order in which they are looked at."""
        out = np.empty((nodes, self.each), dtype=INTS)
        for node in range(nodes):
            high, low = self._next(), self._next()
            draw = XorShift((high << 32) + low - (low >> 31 << 32))
            held = list(range(self.each))
            for feature in range(self.each, self.features):
                at = int(draw.double() * (feature + 1))
                if at < self.each:
                    held[at] = feature
            out[node] = held
        return out


class XorShift:
    """Spark's XORShiftRandom."""

    def __init__(self, seed: int):
        text = (seed & MASK64).to_bytes(8, "big")
        low = _murmur(text, 0x3C074A61)
        self.state = (_murmur(text, low) << 32) | low

    def next(self, bits: int) -> int:
        x = self.state
        x ^= (x << 21) & MASK64
        x ^= x >> 35
        x ^= (x << 4) & MASK64
        self.state = x
        return x & ((1 << bits) - 1)

    def double(self) -> float:
        high = self.next(26)
        return ((high << 27) + self.next(27)) * 2.0**-53

    def int32(self) -> int:
        x = self.next(32)
        return x - (x >> 31 << 32)


def _murmur(text: bytes, seed: int) -> int:
    """MurmurHash3 of whole 4-byte words."""
    turn = lambda x, n: ((x << n) | (x >> (32 - n))) & MASK32
    h = seed
    for i in range(0, len(text), 4):
        k = int.from_bytes(text[i : i + 4], "little")
        k = turn(k * 0xCC9E2D51 & MASK32, 15) * 0x1B873593 & MASK32
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & MASK32
    h ^= len(text)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & MASK32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & MASK32
    return h ^ (h >> 16)


def cut_points(train: DataFrame, features: int, rows: int, bins: int, seed: int, weights: np.ndarray) -> list[list[float]]:
    """Spark ML's candidate thresholds: of all rows, or of the rows that it samples."""
    spark, wanted = train.sparkSession, max(bins * bins, SAMPLED)
    share = wanted / rows if wanted < rows else 1.0
    found = train.select(F.col(LABEL).cast("double").alias("label"), FEATURES)
    if share < 1.0:
        sampled = found._jdf.toJavaRDD().sample(False, share, XorShift(seed).int32())
        found = DataFrame(spark._jsparkSession.createDataFrame(sampled, found._jdf.schema()), spark)
    table = found.select("label", as_array().alias("x")).toArrow()
    if not table.num_rows:
        return [[] for _ in range(features)]
    x, weight = list_matrix(table["x"].combine_chunks()), weights[table["label"].to_numpy().astype(INTS)]
    # Balanced weights add up to the rows.
    return [_thresholds(x[:, j], weight, share * rows, bins) for j in range(features)]


def _thresholds(values: np.ndarray, weights: np.ndarray, expected: float, bins: int) -> list[float]:
    """Midpoints of neighbouring values, all of them or those nearest to equal shares of the rows.

    `expected` rows stand for the sample, and rows that are missing in it count as zeros.
    """
    there = values != 0.0
    found, place = np.unique(values[there], return_inverse=True)
    each = np.bincount(place, weights=weights[there])
    weight = dict(zip(found.tolist(), each.tolist()))
    if not weight:
        return []
    total = float(each.sum())
    if expected - total > EPSILON * len(place) * 100:
        weight[0.0] = expected - total
    places = sorted(weight)
    middles = [(a + b) / 2.0 for a, b in zip(places, places[1:])]
    if len(middles) <= bins - 1:
        return middles
    stride = expected / bins
    out, current, target = [], weight[places[0]], stride
    for i in range(1, len(places)):
        before, current = current, current + weight[places[i]]
        if abs(before - target) < abs(current - target):
            out.append(middles[i - 1])
            target += stride
    return out


def binned(train: DataFrame, edges: list[list[float]]) -> DataFrame:
    """(label, bins): a byte for each feature, in blocks of many rows, which pass the JVM as one value."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = list_matrix(batch.column(1))
                if not np.isfinite(x).all():
                    raise ValueError("a feature is not a finite number")
                label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield _bytes({"label": [label], "bins": [bin_rows(x, edges)]})

    x = train.select(F.col(LABEL).cast("int").alias("label"), as_array().alias("x"))
    return x.mapInArrow(encode, "label binary, bins binary")


def _bytes(arrays: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary()) for values in arrays.values()]
    return pa.RecordBatch.from_arrays(columns, list(arrays))


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(label, bins) of the rows of each block."""
    for batch in batches:
        for label, bins in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(label.as_buffer(), np.uint8), np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, features)


def gini(counts: np.ndarray) -> np.ndarray:
    """1 minus the squared shares of the classes (last axis), one class after the other; 0 without rows."""
    total = counts.sum(axis=-1)
    out = np.ones(total.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(counts.shape[-1]):
            share = counts[..., c] / total
            out -= share * share
    return np.where(total > 0, out, 0.0)


class Best:
    """(gain, feature, cut, counts on the left) of some nodes: the first of the largest gains.

    A node without a valid cut keeps gain -inf.
    """

    def __init__(self, nodes: int, classes: int):
        self.gain, self.feature, self.cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, INTS)
        self.left = np.zeros((nodes, classes))

    def look(self, here: np.ndarray, feature, size, least: int, weights: np.ndarray) -> None:
        """One feature, by (node, bin, class) counts; feature and its bins may differ by node."""
        if here.shape[1] < 2:
            return
        below = np.cumsum(here, axis=1)
        whole, below = below[:, -1:], below[:, :-1]
        above = whole - below
        few = (below.sum(axis=2) < least) | (above.sum(axis=2) < least)
        w_whole, w_below, w_above = whole * weights, below * weights, above * weights
        # No node is without rows.
        n = w_whole.sum(axis=2)
        found = gini(w_whole) - w_below.sum(axis=2) / n * gini(w_below) - w_above.sum(axis=2) / n * gini(w_above)
        past = np.arange(found.shape[1]) >= np.reshape(size, (-1, 1)) - 1
        found[few | (found < 0.0) | past] = -np.inf
        each, at = np.arange(len(found)), found.argmax(axis=1)
        better = found[each, at] > self.gain
        self.gain = np.where(better, found[each, at], self.gain)
        self.feature, self.cut = np.where(better, feature, self.feature), np.where(better, at, self.cut)
        self.left[better] = below[each, at][better]


def best_cuts(cells: np.ndarray, sizes: list[int], least: int, weights: np.ndarray) -> Best:
    """Of all features: (node, bin, class) counts, the bins of one feature after those of another."""
    best, start = Best(len(cells), cells.shape[2]), 0
    for f, size in enumerate(sizes):
        best.look(cells[:, start : start + size], f, size, least, weights)
        start += size
    return best


def histograms(bins: np.ndarray, label: np.ndarray, slot: np.ndarray, slots: int, sizes: list[int], classes: int) -> np.ndarray:
    """(slot, bin, class) counts of some rows."""
    out = np.empty((slots, sum(sizes), classes))
    start = 0
    for f, size in enumerate(sizes):
        cell = (slot * size + bins[:, f]) * classes + label
        out[:, start : start + size] = np.bincount(cell, minlength=slots * size * classes).reshape(slots, size, classes)
        start += size
    return out


class Tree:
    """Nodes as arrays in the order of their making: a child comes after its parent; a leaf has feature -1."""

    def __init__(self, counts: np.ndarray, depth: np.ndarray, weights: np.ndarray):
        nodes, self.weights = len(counts), weights
        self.feature, self.cut = np.full(nodes, -1), np.zeros(nodes, INTS)
        self.left, self.right = np.full(nodes, -1), np.full(nodes, -1)
        self.depth, self.gain, self.counts = depth, np.full(nodes, -1.0), counts

    def add(self, counts: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """New leaves; their numbers."""
        more, first = Tree(counts, depth, self.weights), len(self.feature)
        for name in COLUMNS:
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))
        return np.arange(first, len(self.feature))

    @property
    def weighted(self) -> np.ndarray:
        return self.counts * self.weights

    def split(self, nodes: np.ndarray, gain, feature, cut, left, max_depth: int) -> np.ndarray:
        """Split the nodes whose gain is positive; returns the children that are not leaves for certain.

        A node without a valid cut keeps the gain -inf.
        """
        good = gain > 0
        self.gain[nodes] = np.where(np.isneginf(gain), gain, -1.0)
        nodes, left = nodes[good], left[good]
        if not len(nodes):
            return nodes
        self.gain[nodes], self.feature[nodes], self.cut[nodes] = gain[good], feature[good], cut[good]
        counts = np.stack([left, self.counts[nodes] - left], axis=1).reshape(2 * len(nodes), -1)
        children = self.add(counts, np.repeat(self.depth[nodes] + 1, 2))
        self.left[nodes], self.right[nodes] = children[::2], children[1::2]
        return children[(self.depth[children] < max_depth) & (gini(self.counts[children] * self.weights) >= EPSILON)]

    def below(self, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The child that each row goes to from its node, which must be split."""
        lower = bins[np.arange(len(bins)), self.feature[node]] <= self.cut[node]
        return np.where(lower, self.left[node], self.right[node])

    def router(self) -> Callable[[np.ndarray], np.ndarray]:
        """What gives the node of each row; a leaf leads to itself, so that rows need not be told apart."""
        leaf, own = self.feature < 0, np.arange(len(self.feature))
        feature, cut = np.where(leaf, 0, self.feature), np.where(leaf, 255, self.cut).astype(np.uint8)
        children = np.stack([np.where(leaf, own, self.left), np.where(leaf, own, self.right)], axis=1).ravel()
        steps = int(self.depth.max())

        def route(bins: np.ndarray) -> np.ndarray:
            flat, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
            node = np.zeros(len(bins), dtype=INTS)
            for _ in range(steps):
                higher = flat.take(start + feature.take(node)) > cut.take(node)
                node = children.take(2 * node + higher)
            return node

        return route

    def pruned(self) -> Tree:
        """Two leaves of one prediction become one, from the deepest level up; what is gone is taken out."""
        prediction = self.weighted.argmax(axis=1)
        levels = [np.flatnonzero(self.depth == d) for d in range(self.depth.min(), self.depth.max() + 1)]
        for level in reversed(levels):
            inner = level[self.feature[level] >= 0]
            a, b = self.left[inner], self.right[inner]
            same = (self.feature[a] < 0) & (self.feature[b] < 0) & (prediction[a] == prediction[b])
            self.feature[inner[same]], self.gain[inner[same]] = -1, -1.0
        kept = np.zeros(len(self.feature), bool)
        child = np.zeros(len(self.feature), bool)
        child[self.left[self.left >= 0]] = child[self.right[self.right >= 0]] = True
        kept[~child] = True
        for level in levels:
            inner = level[kept[level] & (self.feature[level] >= 0)]
            kept[self.left[inner]] = kept[self.right[inner]] = True
        number = np.cumsum(kept) - 1
        leaf = self.feature < 0
        self.left, self.right = np.where(leaf, -1, number[self.left]), np.where(leaf, -1, number[self.right])
        for name in COLUMNS:
            setattr(self, name, getattr(self, name)[kept])
        return self


def grow(
    rows: DataFrame, counts: np.ndarray, sizes: list[int], max_depth: int, least: int, weights: np.ndarray, draws: Draws | None = None
) -> Tree:
    """Large nodes by levels over all rows, then the rest in tasks of their own."""
    tree = Tree(counts[None, :].copy(), np.zeros(1, INTS), weights)
    small, large = [], np.array([0] if max_depth > 0 else [], dtype=INTS)
    every = np.arange(len(sizes))[None, :]
    step = max(1, 4 * CELLS // ((draws.each if draws else len(sizes)) * max(sizes) * len(counts)))
    while len(large):
        if draws is None:
            fits = tree.counts[large].sum(axis=1) <= LOCAL_ROWS
            small.append(large[fits])
            large = large[~fits]
        looked = draws.take(len(large)) if draws else np.repeat(every, len(large), axis=0)
        following = []
        for i in range(0, len(large), step):
            found = _level(rows, tree, large[i : i + step], looked[i : i + step], sizes, least)
            following.append(tree.split(*found, max_depth))
        large = np.concatenate(following) if following else large
        if draws:
            # Spark ML takes the child that it made last first.
            large = large[::-1]
    small = np.concatenate(small) if small else large
    return _finished(rows, tree, small, sizes, max_depth, least).pruned()


def _level(rows: DataFrame, tree: Tree, nodes: np.ndarray, looked: np.ndarray, sizes: list[int], least: int) -> tuple[np.ndarray, ...]:
    """(node, gain, feature, cut, counts on the left) of some nodes, from one pass.

    `looked` are the features of each node, in the order in which they count on a tie.
    """
    shape = (len(nodes), looked.shape[1], max(sizes), tree.counts.shape[1])
    slot_of = np.full(len(tree.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    route, weights, size = tree.router(), tree.weights, np.array(sizes)

    def counted(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, held, n = np.zeros(prod(shape), dtype=INTS), [], 0
        for label, bins in _blocks(batches, len(sizes)):
            slot = slot_of[route(bins)]
            inside = np.flatnonzero(slot >= 0)
            label, bins, slot = label[inside], bins[inside], slot[inside]
            place = slot[:, None] * shape[1] + np.arange(shape[1])
            cell = (place * shape[2] + np.take_along_axis(bins, looked[slot], axis=1)) * shape[3] + label[:, None]
            held.append(cell.ravel())
            n += cell.size
            if n >= COUNTED:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        return total + np.bincount(np.concatenate(held), minlength=len(total)) if n else total

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = counted(batches).astype(np.int32).reshape(len(nodes), -1)
        for part in range(0, len(nodes), NODES):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([total[part : part + NODES].tobytes()], pa.binary())], ["part", "cells"]
            )

    def chosen(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        cells = sum(np.frombuffer(piece.as_py(), dtype=np.int32).astype(FLOATS) for piece in table["cells"]).reshape(-1, *shape[1:])
        slots = np.arange(part, part + len(cells))
        best = Best(len(cells), shape[3])
        for place in range(shape[1]):
            feature = looked[slots, place]
            best.look(cells[:, place], feature, size[feature], least, weights)
        columns = [slots.astype(np.int32), best.gain, best.feature.astype(np.int32), best.cut.astype(np.int32), best.left.tolist()]
        return pa.table([pa.array(c) for c in columns], ["slot", "gain", "feature", "cut", "left"])

    held = rows.mapInArrow(partial, "part int, cells binary").groupBy("part")
    found = sorted(held.applyInArrow(chosen, "slot int, gain double, feature int, cut int, left array<double>").collect())
    columns = [np.array([r[c] for r in found]) for c in ("slot", "gain", "feature", "cut", "left")]
    return nodes[columns[0]], *columns[1:]


def _finished(rows: DataFrame, tree: Tree, nodes: np.ndarray, sizes: list[int], max_depth: int, least: int) -> Tree:
    """The tree with the subtrees of `nodes`, whose rows fit a task."""
    if not len(nodes):
        return tree
    held = np.cumsum(tree.counts[nodes].sum(axis=1))
    unit_of = np.full(len(tree.feature), -1)
    unit_of[nodes] = (held - 1) // UNIT_ROWS
    route, classes, depth_of, weights = tree.router(), tree.counts.shape[1], tree.depth, tree.weights

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for label, bins in _blocks(batches, len(sizes)):
            node = route(bins)
            inside = np.flatnonzero(unit_of[node] >= 0)
            held.append((node[inside], label[inside], bins[inside]))
            n += len(inside)
            if n >= COUNTED:
                yield by_unit(held)
                held, n = [], 0
        if n:
            yield by_unit(held)

    def by_unit(held: list[tuple]) -> pa.RecordBatch:
        node, label, bins = (np.concatenate(part) for part in zip(*held))
        unit = unit_of[node]
        order = np.argsort(unit, kind="stable")
        units, starts = np.unique(unit[order], return_index=True)
        pieces = {
            name: np.split(values[order], starts[1:]) for name, values in (("node", node.astype(np.int32)), ("label", label), ("bins", bins))
        }
        return _bytes(pieces).add_column(0, "unit", pa.array(units.astype(np.int32)))

    def subtrees(table: pa.Table) -> pa.Table:
        node, label, bins = (
            np.concatenate([np.frombuffer(piece.as_buffer(), kind) for piece in table[name]])
            for name, kind in (("node", np.int32), ("label", np.uint8), ("bins", np.uint8))
        )
        node, bins = node.astype(INTS), bins.reshape(-1, len(sizes))
        roots, grown = grow_rows(bins, label, node, depth_of, sizes, weights, max_depth, least)
        values = {"roots": roots, **{name: getattr(grown, name) for name in COLUMNS}}
        return pa.table({name: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for name, v in values.items()})

    dealt = rows.mapInArrow(deal, "unit int, node binary, label binary, bins binary")
    for row in dealt.groupBy("unit").applyInArrow(subtrees, GROWN).collect():
        roots = np.frombuffer(row["roots"], INTS)
        part = {name: np.frombuffer(row[name], kind) for name, kind in COLUMNS.items()}
        part["counts"] = part["counts"].reshape(-1, classes)
        new = slice(len(roots), None)
        number = np.concatenate([roots, tree.add(part["counts"][new], part["depth"][new])])
        for name in ("feature", "cut", "gain"):
            getattr(tree, name)[number] = part[name]
        for name in ("left", "right"):
            getattr(tree, name)[number] = np.where(part["feature"] < 0, -1, number[part[name]])
    return tree


def grow_rows(bins, label, node, depth_of, sizes: list[int], weights: np.ndarray, max_depth: int, least: int) -> tuple[np.ndarray, Tree]:
    """The subtrees of the nodes that some rows stand at, side by side: (nodes, trees with these as first nodes)."""
    roots, place = np.unique(node, return_inverse=True)
    classes = len(weights)
    counts = np.bincount(place * classes + label, minlength=len(roots) * classes).reshape(-1, classes).astype(FLOATS)
    tree = Tree(counts, depth_of[roots].copy(), weights)
    open_nodes, at = np.arange(len(roots)), place
    # Nodes are made in the order of their parents, so rows sorted by node stay in pieces.
    order = np.argsort(at, kind="stable")
    bins, label, at = bins[order], label[order], at[order]
    step = max(1, CELLS // (sum(sizes) * classes))
    while len(open_nodes):
        cuts = []
        for i in range(0, len(open_nodes), step):
            some = open_nodes[i : i + step]
            a, b = np.searchsorted(at, [some[0], some[-1] + 1])
            slot = np.searchsorted(some, at[a:b])
            cells = histograms(bins[a:b], label[a:b], slot, len(some), sizes, classes)
            cuts.append(best_cuts(cells, sizes, least, weights))
        found = [np.concatenate([getattr(c, name) for c in cuts]) for name in ("gain", "feature", "cut", "left")]
        open_nodes = tree.split(open_nodes, *found, max_depth)
        # Rows go on to their child; those in leaves are done with.
        moving = tree.feature[at] >= 0
        bins, label = bins[moving], label[moving]
        at = tree.below(at[moving], bins)
        still = np.zeros(len(tree.feature), bool)
        still[open_nodes] = True
        order = np.flatnonzero(still[at])
        order = order[np.argsort(at[order], kind="stable")]
        bins, label, at = bins[order], label[order], at[order]
    # No node is the parent of these, so they stay the first.
    return roots, tree.pruned()


def spark_model(spark, tree: Tree, edges: list[list[float]], estimator):
    """The nodes in Spark ML's stored form, loaded."""
    path = scratch_path(spark, "tree")
    inner = tree.feature >= 0
    size = np.ones(len(inner), INTS)
    levels = [np.flatnonzero(inner & (tree.depth == d)) for d in range(tree.depth.max() + 1)]
    for level in reversed(levels):
        size[level] += size[tree.left[level]] + size[tree.right[level]]
    number = np.zeros(len(inner), INTS)
    for level in levels:
        number[tree.left[level]] = number[level] + 1
        number[tree.right[level]] = number[level] + 1 + size[tree.left[level]]
    longest = max(map(len, edges), default=0) + 1
    threshold = np.array([[*e, *[0.0] * (longest - len(e))] for e in edges])
    at = np.where(inner, tree.feature, 0), np.where(inner, tree.cut, 0)
    ints = lambda values: pa.array(values.astype(np.int32))
    listed = lambda values, each: pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(each)]).astype(np.int32), values)
    parts = [
        ints(np.where(inner, tree.feature, -1)),
        listed(pa.array(threshold[at][inner]), inner),
        ints(np.full(len(inner), -1)),
    ]
    nodes = {
        "id": ints(number),
        "prediction": pa.array(tree.weighted.argmax(axis=1).astype(FLOATS)),
        # Spark ML leaves -1 where no cut is valid.
        "impurity": pa.array(np.where(np.isneginf(tree.gain), -1.0, gini(tree.weighted))),
        "impurityStats": listed(pa.array(tree.weighted.ravel()), np.full(len(inner), tree.counts.shape[1])),
        "rawCount": pa.array(tree.counts.sum(axis=1).astype(INTS)),
        "gain": pa.array(np.where(inner, tree.gain, -1.0)),
        "leftChild": ints(np.where(inner, number[tree.left], -1)),
        "rightChild": ints(np.where(inner, number[tree.right], -1)),
        "split": pa.StructArray.from_arrays(parts, ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]),
    }
    forest = not isinstance(estimator, C.DecisionTreeClassifier)
    kind = "RandomForestClassificationModel" if forest else "DecisionTreeClassificationModel"
    table = spark.createDataFrame(pa.table(nodes))
    if forest:
        table = table.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        own = estimator.copy()
        for name in ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate"):
            own._paramMap.pop(own.getParam(name), None), own._defaultParamMap.pop(own.getParam(name), None)
        part = _metadata(spark, "DecisionTreeClassificationModel", own, f"{estimator.uid}_tree", edges, tree)
        spark.createDataFrame([(0, part, 1.0)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    table.write.parquet(f"{path}/data")
    state = _metadata(spark, kind, estimator, estimator.uid, edges, tree, **({"numTrees": 1} if forest else {}))
    spark.createDataFrame([(state,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    model = getattr(C, kind).load(path)
    remove(spark, path)
    return model


def _metadata(spark, kind: str, estimator, uid: str, edges, tree: Tree, **more) -> str:
    values = lambda params: {p.name: v for p, v in params.items()}
    state = {
        "class": f"org.apache.spark.ml.classification.{kind}",
        "timestamp": int(time.time() * 1000),
        "sparkVersion": spark.version,
        "uid": uid,
        "paramMap": values(estimator._paramMap),
        "defaultParamMap": values(estimator._defaultParamMap),
        "numFeatures": len(edges),
        "numClasses": tree.counts.shape[1],
    }
    return json.dumps({**state, **more})
