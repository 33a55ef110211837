"""Operator 12, hard-negative mining by a secondary-sort shuffle.

Anchors are a stated query set against all rows, in blocks: anchors are dealt to blocks of at
most `ANCHOR_ROWS`, rows to segments, and a unit holds one block while one segment streams past,
so memory is bounded by the block. Scores are integer inner products, exact in double precision
where they stay below 2^53 and in Python integers beyond.

A first pass gives each anchor's positives, its best rows of the same label: every unit passes
its own best on, and the best of those are the best of all. They fix the windows of scores that
negatives may come from. A second pass passes on, for each anchor and window, a unit's first
negatives, which is all that the answer can contain; so the shuffle holds a few rows a unit and
anchor instead of all pairs. These rows get the packed key (anchor, descending score, id), are
repartitioned by anchor and sorted inside partitions. An iterator reads them in that order: a
positive opens a window, a negative goes to the windows that it lies in, and a window closes when
it is full. Only open windows are held, never an anchor's rows. Where a score is shared, positives
stand before negatives, so that a window of a score of zero is open in time.

Defined results: rows without id, label or vector, and vectors with null or non-finite entries or
of another length than the commonest, take no part; rows with the same id count once (the least
by label and vector); an anchor without positives or without negatives in a window gives no
rows for it; ties go to the smaller id; a negative positive_score has an empty window; empty
tables give empty results; other columns have no effect; a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.shared import stored
from tabloom.llm.vectors import common_width, matrix, usable

POSITIVES, NEGATIVES = 5, 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score
ANCHOR_ROWS = 16_384
SEGMENT_ROWS = 16_384
TILE_CELLS = 1 << 22
EXACT = 2.0**53


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: doubles where they are exact, else Python integers."""
    if not len(anchors) or not len(rows):
        return np.zeros((len(anchors), len(rows)))
    top = float(np.abs(anchors.astype(np.float64)).max()) * float(np.abs(rows.astype(np.float64)).max())
    if top * anchors.shape[1] < EXACT:
        return anchors.astype(np.float64) @ rows.astype(np.float64).T
    return anchors.astype(object) @ rows.astype(object).T


def _first(scores: np.ndarray, mask: np.ndarray, count: int) -> np.ndarray:
    """Of each line's masked cells the `count` of highest score; columns stand in order of id."""
    if mask.shape[1] <= count:
        return mask
    held = np.where(mask, scores, -np.inf)
    edge = np.partition(held, held.shape[1] - count, axis=1)[:, -count][:, None]
    above, level = mask & (held > edge), mask & (held == edge)
    return above | (level & (above.sum(1)[:, None] + np.cumsum(level, axis=1) <= count))


def _tiles(width: int, keep):
    """Streams units, each one block of anchors and then the rows of a segment.

    `keep(scores, same, other, windows)` names the cells of a tile to pass on; rows of it are
    (anchor, score, id).
    """

    def run(batches):
        key, waiting, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "segment", "side")], axis=1)
            if not len(keys):
                continue
            ids, values = batch.column("id").to_numpy(), matrix(batch.column("vec"), width)
            labels, windows = batch.column("label").to_numpy(), batch.column("windows").to_pylist()
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
            for start, stop in zip(starts, [*starts[1:], len(keys)]):
                if key != (here := tuple(keys[start, :2])):
                    key, waiting, held = here, [], None
                if not keys[start, 2]:
                    waiting.append((ids[start:stop], labels[start:stop], values[start:stop], windows[start:stop]))
                    continue
                if held is None:
                    held = [np.concatenate(x) for x in list(zip(*waiting))[:3]] + [[w for x in waiting for w in x[3]]] if waiting else ()
                if not held:
                    continue
                a_ids, a_labels, a_values, a_windows = held
                step = max(64, TILE_CELLS // len(a_ids))
                order = start + np.argsort(ids[start:stop], kind="stable")
                for at in range(0, len(order), step):
                    some = order[at : at + step]
                    scores = _scores(a_values, values[some])
                    alike = a_labels[:, None] == labels[some][None, :]
                    passed = keep(scores, alike & (a_ids[:, None] != ids[some][None, :]), ~alike, a_windows)
                    i, j = np.nonzero(passed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a_ids[i]), pa.array(scores[i, j].astype(np.int64)), pa.array(ids[some][j])], names=["anchor", "score", "id"]
                    )

    return run


def _positives(count: int):
    return lambda scores, same, other, windows: _first(scores, same, count)


def _negatives(count: int, lowest: int, highest: int):
    def keep(scores, same, other, windows):
        passed = np.zeros(scores.shape, bool)
        for w in range(max(map(len, windows), default=0)):
            of = np.flatnonzero([len(x) > w for x in windows])
            edge = np.array([windows[k][w] for k in of], dtype=scores.dtype)[:, None]
            inside = other[of] & (100 * scores[of] >= lowest * edge) & (100 * scores[of] <= highest * edge)
            passed[of] |= _first(scores[of], inside, count)
        return passed

    return keep


def _mined(count_positives: int, count_negatives: int, lowest: int, highest: int):
    """Rows sorted by (anchor, descending score, kind, id): opens windows and fills them."""

    def run(batches):
        anchor, seen, windows = None, 0, []
        for batch in batches:
            anchors, down = batch.column("anchor").to_numpy(), batch.column("down").to_numpy()
            ids, positive = batch.column("id").to_numpy(), batch.column("kind").to_numpy() == 0
            out = []
            starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(anchors) else []
            for start, stop in zip(starts, [*starts[1:], len(anchors)]):
                if anchors[start] != anchor:
                    anchor, seen, windows = anchors[start], 0, []
                for at in start + np.flatnonzero(positive[start:stop])[: count_positives - seen]:
                    windows.append([int(ids[at]), -int(down[at]), 0])
                    seen += 1
                against = start + np.flatnonzero(~positive[start:stop])
                for window in windows:
                    chosen, score, filled = window
                    first = np.searchsorted(down[against], -(highest * score // 100), side="left")
                    last = np.searchsorted(down[against], -(-(-lowest * score // 100)), side="right")
                    for at in against[first : min(last, first + count_negatives - filled)]:
                        window[2] += 1
                        out.append((int(anchor), chosen, window[2], int(ids[at]), score, -int(down[at])))
                windows = [w for w in windows if w[2] < count_negatives]
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    anchor_rows: int = ANCHOR_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """For each anchor and each of its positives the first negatives of the positive's window.

    `vector` holds whole numbers (array<bigint>); `lowest` and `highest` bound a negative's score
    in percent of the positive's.
    """
    vec = F.col(vector)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = stored(rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))), "rows")
    width = common_width(rows, "vec")
    rows = rows.where(F.size("vec") == width)
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # equal ids: the least by label and vector
        best = rows.join(again.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("r"))
        rows = stored(rows.join(again, "id", "left_anti").unionByName(best.select("id", "r.label", "r.vec", "r.anchor")), "rows")
    anchors = rows.where("anchor").select("id", "label", "vec")
    blocks = max(1, -(-anchors.count() // anchor_rows))
    segments = max(1, -(-rows.count() // segment_rows))

    def spread(df: DataFrame, side: int, own: str, own_n: int, every: str, every_n: int) -> DataFrame:
        dealt = df.withColumn(own, F.pmod(F.xxhash64(F.lit(side), "id"), F.lit(own_n)).cast("int"))
        dealt = dealt.withColumn(every, F.explode(F.sequence(F.lit(0), F.lit(every_n - 1))))
        return dealt.select("block", "segment", F.lit(side).alias("side"), "id", "label", "vec", "windows")

    def scored(anchors: DataFrame, keep) -> DataFrame:
        plain = rows.select("id", "label", "vec", F.lit(None).cast("array<bigint>").alias("windows"))
        units = spread(anchors, 0, "block", blocks, "segment", segments).unionByName(spread(plain, 1, "segment", segments, "block", blocks))
        units = units.repartition("block", "segment").sortWithinPartitions("block", "segment", "side")
        return units.mapInArrow(_tiles(width, keep), "anchor long, score long, id long")

    found = scored(anchors.withColumn("windows", F.lit(None).cast("array<bigint>")), _positives(positives))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    chosen = stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives).drop("r"), "positives")
    windows = chosen.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("windows"))
    against = scored(anchors.join(windows, "id"), _negatives(negatives, lowest, highest))

    packed = ["anchor", (-F.col("score")).alias("down")]
    pairs = chosen.select(*packed, F.lit(0).alias("kind"), "id").unionByName(against.select(*packed, F.lit(1).alias("kind"), "id"))
    pairs = pairs.repartition("anchor").sortWithinPartitions("anchor", "down", "kind", "id")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return pairs.mapInArrow(_mined(positives, negatives, lowest, highest), schema)
