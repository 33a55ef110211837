"""Operator 13, embedding near-dedup by a subspace pigeonhole join.

Unit vectors with a cosine of at least c are at most sqrt(2 - 2c) apart. They are rotated to the
principal axes of a bounded sample, and the axes are dealt to blocks of `BLOCK_DIMS`. Each block
gets a part of the squared distance in proportion to its variance, so a pair within the whole
budget is within the budget of at least one block. Every block is a range join in few
dimensions: quantiles of the sample cut its axes into cells, a vector is a member of its own cell
and a probe of every other cell that its range reaches (of two cells only one direction is sent).
Members of a cell are cut into chunks; probes stream past a chunk, which bounds the memory of a
task. A pair within the block's budget is a candidate. It is verified at once by its cosine in
double precision, in the first block that finds it only, so the union of candidates holds each
pair once.

A unit returns a number of links for each vector and edges that span the components it saw, never
its pairs, so a group of copies costs rows in proportion to its members. Equal vectors are one
vector with a weight. Components come from alternating stars. Sample and cuts decide the speed
only: all vectors are compared, whatever the number of cells.

Block distances are integers (coordinates in steps of 2^-16), so every task agrees about the
first block of a pair; budgets are widened by the rounding. With a flat spectrum and few cells
the range of a vector reaches a large part of all cells, and the work tends to that of all
pairs in blocks; with a falling spectrum most cells are out of reach.

Defined results: vectors that are null, empty, zero or hold null or non-finite entries link with
nothing, as do those whose length is not the commonest one; repeated rows are vectors of their
own and link with each other; a null id is never the least one and is not kept; an empty table
gives an empty result; columns beside id and vector have no effect.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.near_dedup import components
from tabloom.llm.shared import stored
from tabloom.llm.vectors import common_width, matrix, usable
from tabloom.session import small_table

THRESHOLD = 0.95
BLOCK_DIMS = 8
CELL_ROWS = 4096
TILE = 1024
SAMPLE_ROWS = 20_000
UNIT_STEP = 2.0**20
STEP = 2.0**16


def scaled(values: np.ndarray) -> np.ndarray:
    """Rows as doubles, by a power of two next to their largest entry, so that squares stay finite."""
    values = values.astype(np.float64)
    _, exponent = np.frexp(np.abs(values).max(axis=1, initial=0.0))
    return np.ldexp(values, -exponent[:, None])


def norms(values: np.ndarray) -> np.ndarray:
    """Lengths, added up column by column: a row's result does not depend on its neighbours."""
    total = np.zeros(len(values))
    for j in range(values.shape[1]):
        total += values[:, j] * values[:, j]
    return np.sqrt(total)


@dataclass
class Layout:
    """The rotation, the blocks with their budgets, and the cuts of each block's axes."""

    rotation: np.ndarray  # d x d, whole multiples of 1 / UNIT_STEP, times UNIT_STEP
    blocks: list[np.ndarray]  # axes of each block
    budgets: list[float]  # largest squared distance in units of 1 / STEP**2
    cuts: list[list[tuple[int, np.ndarray]]]  # for each block: axis, its inner cuts

    def rotate(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Coordinates in whole steps; sums of whole numbers below 2^53 are exact in any order."""
        whole = np.rint(values / lengths[:, None] * UNIT_STEP)
        return np.rint(whole @ self.rotation / (UNIT_STEP * UNIT_STEP / STEP))

    def home(self, block: int, points: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(points), np.int64)
        for axis, cuts in self.cuts[block]:
            cell = cell * (len(cuts) + 1) + np.searchsorted(cuts, points[:, axis], side="right")
        return cell

    def reached(self, block: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the block's budget of a row's coordinates."""
        row = np.arange(len(points))
        cell, spent = np.zeros(len(points), np.int64), np.zeros(len(points))
        for axis, cuts in self.cuts[block]:
            low, high = np.concatenate([[-np.inf], cuts]), np.concatenate([cuts, [np.inf]])
            at = points[row, axis][:, None]
            gap = np.maximum(np.maximum(low[None, :] - at, at - high[None, :]), 0.0)
            total = spent[:, None] + gap * gap
            keep, part = np.nonzero(total <= self.budgets[block])
            row, cell, spent = row[keep], cell[keep] * len(low) + part, total[keep, part]
        return row, cell


def fit_layout(sample: np.ndarray, rows: int, threshold: float, block_dims: int, cell_rows: int) -> Layout:
    """Axes, budgets and cuts from a bounded sample; `rows` decides the number of cells."""
    values = scaled(sample)
    lengths = norms(values)
    units = values / lengths[:, None]
    width = units.shape[1]
    _, axes = np.linalg.eigh(np.cov(units.T, bias=True).reshape(width, width))
    rotation = axes[:, ::-1]
    variance = (units @ rotation).var(axis=0) + 1e-9
    count = -(-width // block_dims)
    blocks: list[list[int]] = [[] for _ in range(count)]
    for axis in range(width):  # forth and back, so that blocks have like variances
        turn, place = divmod(axis, count)
        blocks[count - 1 - place if turn % 2 else place].append(axis)
    slack = np.sqrt(width) / UNIT_STEP + width / UNIT_STEP
    whole = 2.0 - 2.0 * threshold + 1e-9
    layout = Layout(np.rint(rotation * UNIT_STEP), [np.array(b) for b in blocks], [], [])
    points = layout.rotate(values, lengths)
    bits = max(0, int(np.ceil(np.log2(max(1, rows) / cell_rows))))
    for axes_of in layout.blocks:
        share = variance[axes_of].sum() / variance.sum()
        radius = np.sqrt(whole * share) + slack + np.sqrt(len(axes_of)) / STEP
        layout.budgets.append(float(np.ceil((radius * STEP) ** 2)))
        spread = np.sqrt(variance[axes_of])
        halvings = np.zeros(len(axes_of), int)
        for _ in range(bits):
            halvings[np.argmax(spread / 2.0**halvings)] += 1
        cuts = []
        for axis, h in zip(axes_of, halvings):
            if h:
                at = np.quantile(points[:, axis], np.arange(1, 2**h) / 2**h)
                cuts.append((int(axis), np.unique(np.rint(at))))
        layout.cuts.append(cuts)
    return layout


def _sent(home: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Of two cells that reach each other, one direction."""
    return np.where((home + cell) % 2 == 0, cell > home, cell < home)


def _homes(layout: Layout, width: int):
    def run(batches):
        for batch in batches:
            values = scaled(matrix(batch.column("vec"), width))
            points = layout.rotate(values, norms(values))
            for block in range(len(layout.blocks)):
                cell = layout.home(block, points)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), block, np.int32)), pa.array(cell)], names=["block", "cell"])

    return run


def _dealt(layout: Layout, width: int):
    """Each vector for its own cell and for the cells it probes, in every block."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, TILE):
                batch = whole.slice(start, TILE)
                values = scaled(matrix(batch.column("vec"), width))
                points = layout.rotate(values, norms(values))
                for block in range(len(layout.blocks)):
                    home = layout.home(block, points)
                    row, cell = layout.reached(block, points)
                    keep = (cell == home[row]) | _sent(home[row], cell)
                    row, cell = row[keep], cell[keep]
                    picked = batch.take(pa.array(row))
                    extra = [pa.array(np.full(len(row), block, np.int32)), pa.array(cell), pa.array(cell == home[row])]
                    yield pa.RecordBatch.from_arrays([*picked.columns, *extra], names=["rep", "weight", "vec", "block", "cell", "own"])

    return run


class _Unit:
    """The members of one chunk of a cell, and what their pairs with streaming probes gave."""

    def __init__(self, layout: Layout, block: int, threshold: float, reps, weights, values):
        self.layout, self.block, self.threshold = layout, block, threshold
        self.reps, self.weights = reps, weights
        self.values = scaled(values)
        self.lengths = norms(self.values)
        self.points = layout.rotate(self.values, self.lengths)
        self.links = np.zeros(len(reps), np.int64)
        self.label = np.arange(len(reps))
        for start in range(0, len(reps), TILE):
            self._pairs(slice(start, start + TILE))

    def _found(self, values, lengths, points, first: int | None):
        """(member, probe) of the linked pairs that no earlier block finds."""
        axes, budgets = self.layout.blocks, self.layout.budgets
        mine, other = self.points[:, axes[self.block]], points[:, axes[self.block]]
        apart = (mine * mine).sum(1)[:, None] + (other * other).sum(1)[None, :] - 2.0 * (mine @ other.T)
        near = apart <= budgets[self.block]
        if first is not None:  # the probes are members themselves: each pair once
            near &= np.arange(len(mine))[:, None] < first + np.arange(len(other))[None, :]
        hits = np.flatnonzero(near)
        members, probes = [], []
        for start in range(0, len(hits), 1 << 16):
            i, p = np.divmod(hits[start : start + (1 << 16)], len(other))
            for b in range(self.block):
                gap = self.points[i][:, axes[b]] - points[p][:, axes[b]]
                later = (gap * gap).sum(1) > budgets[b]
                i, p = i[later], p[later]
            dots = np.einsum("ij,ij->i", self.values[i], values[p])
            linked = dots / (self.lengths[i] * lengths[p]) >= self.threshold
            members.append(i[linked])
            probes.append(p[linked])
        return (np.concatenate(members), np.concatenate(probes)) if members else (hits, hits)

    def _join(self, i: np.ndarray, group: np.ndarray, groups: int) -> None:
        """One component for all members of the same group."""
        while len(i):
            least = np.full(groups, len(self.reps))
            np.minimum.at(least, group, self.label[i])
            if (self.label[i] == least[group]).all():
                return
            parent = np.arange(len(self.reps))
            np.minimum.at(parent, self.label[i], least[group])
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.label = parent[self.label]

    def _pairs(self, rows: slice) -> None:
        i, p = self._found(self.values[rows], self.lengths[rows], self.points[rows], rows.start)
        p = p + rows.start
        np.add.at(self.links, i, self.weights[p])
        np.add.at(self.links, p, self.weights[i])
        self._join(np.concatenate([i, p]), np.concatenate([p, p]), len(self.reps))

    def probe(self, reps, weights, values):
        """What a batch of probes has found: rows (a, b, links)."""
        values = scaled(values)
        lengths = norms(values)
        i, p = self._found(values, lengths, self.layout.rotate(values, lengths), None)
        if not len(i):
            return None
        np.add.at(self.links, i, weights[p])
        links = np.zeros(len(reps), np.int64)
        np.add.at(links, p, self.weights[i])
        self._join(i, p, len(reps))
        seen, at = np.unique(p, return_index=True)
        return _rows(reps[seen], links[seen], reps[seen], self.reps[i[at]])

    def rest(self):
        linked, joined = self.links > 0, self.label != np.arange(len(self.reps))
        return _rows(self.reps[linked], self.links[linked], self.reps[joined], self.reps[self.label[joined]])


def _rows(reps, links, left, right) -> pa.RecordBatch:
    def column(first, second):
        return pa.concat_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())])

    return pa.RecordBatch.from_arrays(
        [column(reps, left), column([None] * len(reps), right), column(links, [None] * len(left))], names=["a", "b", "links"]
    )


def _searched(layout: Layout, width: int, threshold: float):
    """Units arrive one after the other, the members of each before its probes."""

    def run(batches):
        key, unit, waiting = None, None, []

        def opened():
            parts = [np.concatenate(x) for x in zip(*waiting)]
            return _Unit(layout, key[0], threshold, *parts) if parts else None

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "cell", "chunk", "probe")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
            reps, weights = batch.column("rep").to_numpy(), batch.column("weight").to_numpy()
            values = matrix(batch.column("vec"), width)
            for start, stop in zip(starts, [*starts[1:], len(keys)]):
                here = tuple(keys[start, :3])
                if here != key:
                    if key is not None and (unit := unit or opened()):
                        yield unit.rest()
                    key, unit, waiting = here, None, []
                if not keys[start, 3]:
                    waiting.append((reps[start:stop], weights[start:stop], values[start:stop]))
                    continue
                if unit is None:
                    unit, waiting = opened(), []
                    if unit is None:  # a cell that some vectors reach and none lives in
                        unit = False
                for at in range(start, stop if unit else start, TILE):
                    some = slice(at, min(at + TILE, stop))
                    if (out := unit.probe(reps[some], weights[some], values[some])) is not None:
                        yield out
        if key is not None and unit is not False and (unit := unit or opened()):
            yield unit.rest()

    return run


def _linked(reps: DataFrame, width: int, threshold: float, block_dims: int, cell_rows: int, sample_rows: int) -> DataFrame:
    """(a, b, links) of all units: numbers of links with b null, edges with links null."""
    rows = reps.count()
    share = min(1.0, sample_rows / max(1, rows))
    sample = reps.where(F.pmod("h1", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample_rows).select("vec").toArrow()
    picked = matrix(sample.column("vec").combine_chunks(), width)
    layout = fit_layout(picked if len(picked) else np.eye(width), rows, threshold, block_dims, cell_rows)
    slim = reps.select("rep", "weight", "vec")

    homes = slim.select("vec").mapInArrow(_homes(layout, width), "block int, cell long")
    chunks = F.ceil(F.col("members") / cell_rows).cast("int").alias("chunks")
    full = homes.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cell_rows)
    full = small_table(full.select("block", "cell", chunks))

    kind = reps.schema["vec"].dataType.simpleString()
    dealt = slim.mapInArrow(_dealt(layout, width), f"rep long, weight long, vec {kind}, block int, cell long, own boolean")
    dealt = dealt.join(full, ["block", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.when(F.col("own"), F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    dealt = dealt.withColumn("mine", mine)
    last = F.coalesce("mine", F.col("chunks") - 1)
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.withColumn("probe", F.when(F.col("chunk").eqNullSafe(F.col("mine")), 0).otherwise(1))
    unit = ["block", "cell", "chunk"]
    dealt = dealt.select(*unit, "probe", "rep", "weight", "vec").repartition(*unit).sortWithinPartitions(*unit, "probe")
    return stored(dealt.mapInArrow(_searched(layout, width, threshold), "a long, b long, links long"), "vector-links")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
    block_dims: int = BLOCK_DIMS,
    cell_rows: int = CELL_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: its links and the least id in reach."""
    vec, key = F.col(vector), F.col(id_col)
    zero = F.forall(vec, lambda x: x == 0)
    rows = df.select(key.alias("id"), F.when(usable(vec) & ~zero, vec).alias("vec"))
    width = common_width(rows.where("vec is not null"), "vec")
    rows = rows.withColumn("vec", F.when(F.size("vec") == width, F.col("vec")))
    hashed = rows.where("vec is not null").withColumns({"h1": F.xxhash64(F.lit(1), "vec"), "h2": F.xxhash64(F.lit(2), "vec")})
    reps = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("vec").alias("vec"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    if width == 0:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))

    found = _linked(reps, width, threshold, block_dims, cell_rows, sample_rows)
    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comps = stored(components(found.where("b is not null").select("a", "b")), "components")
    nodes = comps.join(reps.select(F.col("rep").alias("node"), "least"), "node")
    least = nodes.groupBy("comp").agg(F.min("least").alias("smallest"))
    settled = comps.join(least, "comp").select(F.col("node").alias("rep"), "smallest")
    per_rep = reps.select("h1", "h2", "rep", "weight", "least").join(links, "rep", "left").join(settled, "rep", "left")
    per_rep = per_rep.select(
        "h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")
    )
    plain = rows.select("id", F.xxhash64(F.lit(1), "vec").alias("h1"), F.xxhash64(F.lit(2), "vec").alias("h2"), F.col("vec").isNull().alias("none"))
    alone = plain.where("none").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    joined = plain.where("not none").join(per_rep, ["h1", "h2"]).select("id", "n_links", "component_id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
