"""Histogram trees grown level by level, the base of all boosted models here.

Rows never move. For each level every partition adds its rows into a (node, feature,
bin) histogram, Spark sums the histograms and picks the best split per node, and only
one row per open node reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import list_matrix, stack
from .base import KEY, as_array

MAX_BINS = 128
BINS = MAX_BINS + 1
HISTOGRAM_CELLS = 4_000_000


@dataclass
class Tree:
    """Flat arrays; node 0 is the root and a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    stats: list[list[float]] = field(default_factory=lambda: [[]])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, left: list[float], right: list[float]) -> tuple[int, int]:
        children = []
        for stats in (left, right):
            for store, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.gain, 0.0)):
                store.append(empty)
            self.stats.append(stats)
            self.value.append(0.0)
            children.append(len(self.feature) - 1)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        return children[0], children[1]

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row so far."""
        feature, cut = np.asarray(self.feature), np.asarray(self.cut)
        left, right = np.asarray(self.left), np.asarray(self.right)
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            here = node[rows]
            below = bins[rows, feature[here]] <= cut[here]
            node[rows] = np.where(below, left[here], right[here])
        return node

    def output(self, bins: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.route(bins)]

    def leaves(self) -> list[int]:
        return [i for i, f in enumerate(self.feature) if f < 0]


@dataclass(frozen=True)
class SplitRule:
    """How a split is judged.

    `newton`: stats are (gradient, curvature); with curvature 1 this is the variance
    rule. `gini`: stats are the class weights. `poisson`: stats are (minus the label's sum, rows);
    a side without a positive sum is refused.
    """

    kind: str = "newton"
    reg_lambda: float = 0.0
    reg_alpha: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 0.0
    min_leaf: int = 1
    min_split: int = 2

    def leaf(self, stats: Sequence[float]) -> float:
        g, h = stats
        if self.reg_alpha:
            g = np.sign(g) * max(abs(g) - self.reg_alpha, 0.0)
        return float(-g / (h + self.reg_lambda)) if h + self.reg_lambda > 0 else 0.0


def per_tree(rules: Sequence[SplitRule], name: str) -> str:
    """A field of the rules as SQL text: one number, or one for each tree."""
    values = [float(getattr(r, name)) for r in rules]
    if len(set(values)) == 1:
        return f"{values[0]}D"
    return f"element_at(array({', '.join(f'{v}D' for v in values)}), tree + 1)"


def quality(rules: Sequence[SplitRule], stats: Sequence[str]) -> str:
    """Score of a group of rows as SQL text over its summed stats."""
    if rules[0].kind == "gini":
        squares = " + ".join(f"({s}) * ({s})" for s in stats)
        return f"coalesce(try_divide({squares}, {' + '.join(f'({s})' for s in stats)}), 0D)"
    g, h = (f"({s})" for s in stats)
    if rules[0].kind == "poisson":
        return f"(case when {g} < 0 and {h} > 0 then -{g} * ln(-{g} / {h}) end)"
    if any(r.reg_alpha for r in rules):
        g = f"(signum({g}) * greatest(abs({g}) - {per_tree(rules, 'reg_alpha')}, 0D))"
    return f"coalesce(try_divide(0.5D * {g} * {g}, {h} + {per_tree(rules, 'reg_lambda')}), 0D)"


def bin_edges(df: DataFrame, features: int, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending cut points per feature from mergeable quantile sketches, in one pass."""
    probs = ", ".join(f"{i / max_bins}D" for i in range(1, max_bins))
    x = df.select(as_array().alias("x"))
    row = x.agg(*[F.expr(f"percentile_approx(x[{j}], array({probs}), 10000) as q{j}") for j in range(features)]).first()
    return [sorted(set(row[f"q{j}"] or [])) for j in range(features)]


def bin_rows(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin b holds the values in (edge b-1, edge b]."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, cuts in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(cuts), x[:, j], side="left")
    return out


def binned(df: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Replace the feature vector by one byte per feature."""

    @F.pandas_udf("binary")
    def encode(x: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in bin_rows(stack(x), edges)])

    rest = [c for c in df.columns if c != "features"]
    return df.select(*rest, encode(as_array()).alias("bins"))


def unpack(column: pd.Series | pa.Array, features: int) -> np.ndarray:
    if isinstance(column, pa.Array):
        # The bytes of all rows lie one after the other.
        _, places, data = column.buffers()
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        places = np.frombuffer(places, dtype=kind)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]].reshape(len(column), features)
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), features)


class Batch:
    """An Arrow batch by column: arrays as a matrix, bytes as they are, anything else as a series.

    Nothing becomes an object for each row, and columns that are not asked for are not converted.
    """

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __len__(self) -> int:
        return self.batch.num_rows

    def __getitem__(self, name: str):
        column = self.batch.column(name)
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            return column
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            return list_matrix(column)
        return column.to_pandas()


StatsOf = Callable[[Batch, np.ndarray], np.ndarray]


def grow(
    rows: DataFrame,
    features: int,
    stats_of: StatsOf,
    n_stats: int,
    rule: SplitRule | Sequence[SplitRule],
    max_depth: int | Sequence[int],
    n_trees: int = 1,
    use: Sequence[int] | Sequence[Sequence[int]] | None = None,
    places: Sequence[int] | None = None,
) -> list[Tree]:
    """Grow `n_trees` trees side by side on the same rows.

    `stats_of(batch, bins)` gives an array (n_trees, rows, n_stats); a row whose first number is
    NaN takes no part in that tree. Trees may differ in rule, depth and used features. If rows
    hold the bins of several sets of edges one after the other, `places` names the set of each
    tree.
    """
    rules = [rule] * n_trees if isinstance(rule, SplitRule) else list(rule)
    depths = [max_depth] * n_trees if isinstance(max_depth, int) else list(max_depth)
    if use is None:
        use = range(features)
    each = len(use) > 0 and not isinstance(use[0], (int, np.integer))
    used = [sorted(u) for u in use] if each else [sorted(use)] * n_trees
    trees = [Tree() for _ in range(n_trees)]
    active: list[dict[int, int]] = [{0: 0} if d > 0 else {} for d in depths]
    plan = _Plan(features, stats_of, n_stats, rules, used, list(places or [0] * n_trees), max(places or [0]) + 1)
    for depth in range(max(depths, default=0)):
        found = _best_splits(rows, plan, trees, active)
        following: list[dict[int, int]] = [{} for _ in trees]
        for row in found:
            tree, node = trees[row["tree"]], row["node"]
            own = rules[row["tree"]]
            total = [row["best"][f"t{i}"] for i in range(n_stats)]
            if not tree.stats[node]:
                tree.stats[node] = total
            if row["best"]["n"] < own.min_split or row["gain"] is None or row["gain"] <= own.min_gain + 1e-12:
                continue
            left = [row["best"][f"l{i}"] for i in range(n_stats)]
            right = [t - s for t, s in zip(total, left)]
            children = tree.split(node, row["feature"], row["best"]["bin"], row["gain"], left, right)
            if depth + 1 < depths[row["tree"]]:
                for child in children:
                    following[row["tree"]][child] = len(following[row["tree"]])
        active = following
        if not any(active):
            break
    return trees


@dataclass(frozen=True)
class _Plan:
    """What the trees of one call share, and where they differ (lists by tree)."""

    features: int
    stats_of: StatsOf
    n_stats: int
    rules: list[SplitRule]
    used: list[list[int]]
    places: list[int]
    sets: int


def _best_splits(rows, plan: _Plan, trees, active) -> list:
    """Best split per open node, the smallest feature on a tie.

    The driver sees one row per open node. A level whose histogram would be large runs in
    pieces.
    """
    widest = max(map(len, plan.used))
    per_feature = max(len(a) for a in active) * BINS
    cells = HISTOGRAM_CELLS // (plan.n_stats + 1)
    tree_step = max(1, cells // (per_feature * widest))
    feature_step = max(1, min(widest, cells // per_feature))
    open_trees = [t for t, nodes in enumerate(active) if nodes]
    best: dict[tuple[int, int], object] = {}
    for t in range(0, len(open_trees), tree_step):
        here = open_trees[t : t + tree_step]
        for f in range(0, widest, feature_step):
            for row in _level(rows, plan, trees, active, here, slice(f, f + feature_step)):
                held = best.get((row["tree"], row["node"]))
                if held is None or (row["gain"] or -1.0) > (held["gain"] or -1.0):
                    best[row["tree"], row["node"]] = row
    return [best[k] for k in sorted(best)]


def _level(rows, plan: _Plan, trees, active, open_trees: list[int], some: slice) -> list:
    slots = max(len(active[t]) for t in open_trees)
    bins_max, features, n_stats, stats_of, sets = BINS, plan.features, plan.n_stats, plan.stats_of, plan.sets
    used = {t: np.array(plan.used[t][some], dtype=np.int64) for t in open_trees}
    open_trees = [t for t in open_trees if len(used[t])]
    if not open_trees:
        return []
    width = max(map(len, used.values()))
    grown = {t: (trees[t], plan.places[t] * features, list(active[t].items())) for t in open_trees}

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(open_trees), n_stats + 1, slots * width * bins_max))
        for batch in map(Batch, batches):
            if not len(batch):
                continue
            bins = unpack(batch["bins"], features * sets)
            stats = stats_of(batch, bins)
            for o, t in enumerate(open_trees):
                tree, place, nodes = grown[t]
                own = bins[:, place : place + features]
                lookup = np.full(len(tree.feature), -1, dtype=np.int64)
                for node, slot in nodes:
                    lookup[node] = slot
                slot = lookup[tree.route(own)]
                inside = (slot >= 0) & ~np.isnan(stats[t][:, 0])
                cells = own[inside][:, used[t]] + np.arange(len(used[t])) * bins_max
                cell = (cells + (slot[inside] * width * bins_max)[:, None]).ravel()
                for s in range(n_stats):
                    weight = np.repeat(stats[t][inside, s], len(used[t]))
                    total[o, s] += np.bincount(cell, weights=weight, minlength=total.shape[2])
                total[o, n_stats] += np.bincount(cell, minlength=total.shape[2])
        for o, t in enumerate(open_trees):
            filled = np.nonzero(total[o, n_stats])[0]
            slot, rest = np.divmod(filled, width * bins_max)
            feature, cell = np.divmod(rest, bins_max)
            nodes = np.array([node for node, _ in sorted(grown[t][2], key=lambda x: x[1])], dtype=np.int64)
            frame = {"tree": np.full(len(filled), t, dtype=np.int32), "node": nodes[slot].astype(np.int32)}
            frame["feature"] = used[t][feature].astype(np.int32)
            frame["bin"] = cell.astype(np.int32)
            for s in range(n_stats):
                frame[f"s{s}"] = total[o, s][filled]
            frame["n"] = total[o, n_stats][filled].astype(np.int64)
            yield pa.RecordBatch.from_pydict(frame)

    names = [f"s{i}" for i in range(n_stats)]
    schema = "tree int, node int, feature int, bin int, " + ", ".join(f"{n} double" for n in names) + ", n long"
    # Tasks emit combined histograms, so one exchange by (tree, node, feature) serves the
    # sum, the running totals and the choice of the best cut.
    keys = ["tree", "node", "feature"]
    left, whole = [f"l{i}" for i in range(n_stats)], [f"t{i}" for i in range(n_stats)]
    right = [f"{t} - {s}" for s, t in zip(left, whole)]
    over = "over (partition by tree, node, feature order by bin rows between unbounded preceding and current row)"
    around = "over (partition by tree, node, feature)"
    rules = plan.rules
    least = per_tree(rules, "min_leaf")
    valid = f"ln >= {least} and n - ln >= greatest(1D, {least})"
    if any(r.min_weight for r in rules):
        weight = per_tree(rules, "min_weight")
        valid += f" and l1 >= {weight} and t1 - l1 >= {weight}"
    gain = f"{quality(rules, left)} + {quality(rules, right)} - {quality(rules, whole)}"
    picked = ", ".join(["bin", "n", *left, *whole])
    best = (
        rows.drop(KEY).mapInArrow(histograms, schema)
        .repartition(*keys)
        .groupBy(*keys, "bin")
        .agg(F.expr(f"struct({', '.join(f'sum({n}) as {n}' for n in [*names, 'n'])}) as h"))
        .selectExpr(
            *keys,
            "bin",
            *[f"sum(h.{n}) {over} as {a}" for n, a in zip(names, left)],
            *[f"sum(h.{n}) {around} as {a}" for n, a in zip(names, whole)],
            f"sum(h.n) {over} as ln",
            f"sum(h.n) {around} as n",
        )
        .selectExpr(*keys, f"struct({picked}) as picked", "bin", f"case when {valid} then {gain} end as gain")
        .groupBy(*keys)
        .agg(F.expr("max_by(picked, struct(coalesce(gain, double('-inf')), -bin)) as best"), F.expr("max(gain) as gain"))
        .groupBy("tree", "node")
        .agg(F.expr("max_by(struct(feature, best, gain), struct(coalesce(gain, double('-inf')), -feature)) as top"))
        .select("tree", "node", "top.*")
    )
    return best.collect()


def importance_of(trees: Sequence[Tree], features: int) -> np.ndarray:
    total = np.zeros(features)
    for tree in trees:
        for feature, gain in zip(tree.feature, tree.gain):
            if feature >= 0:
                total[feature] += gain
    return total / total.sum() if total.sum() > 0 else total
