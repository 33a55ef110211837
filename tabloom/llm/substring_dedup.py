"""Operator 1, substring dedup by hashed units of text.

Units are lines, cut further at sentence ends (a word that ends in . ! or ?), so that a passage
is found wherever it stands in a line. A unit is normalised to its lower-cased words. From each
unit a stretch of whole units is taken until it has `min_words` words; its 128-bit digest is
grouped globally. The occurrence of lowest rank (doc_id, text, offset) stays; all others are
removed, short units inside them included. Removed spans are kept as code point offsets into
the original text.

Digests are counted with a map-side combine and joined back by digest; the join has one row
for each digest on one side, so AQE can split a passage that stands in a third of all rows.

Defined results: a null text counts as empty and keeps null; repeats inside one document count
as well; rows equal in id and text are one document and get the same result; null ids rank
first; a passage of fewer than `min_words` words, or one that shares no whole unit, stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import text_of
from tabloom.llm.words import NEWLINE, Texts, hashes, runs, scramble, slices

#: Shorter stretches are often ordinary sentences that unrelated documents share.
MIN_WORDS = 20
WINDOWS = "d1 long, d2 long, doc_id long, digest long, at int, stop int"
#: What stands between two units that were both removed is removed with them, if it is short.
GAP = 2

SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?")] = True


def _units(texts: Texts, words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word of each unit and the end, text of each unit)."""
    n = len(words.starts)
    last = SENTENCE_END[texts.data[words.ends - 1]]
    newlines = np.cumsum(texts.data == NEWLINE)  # texts end with a line break, so lines also end there
    line = newlines[words.starts]
    last[:-1] |= line[1:] != line[:-1]
    last[-1] = True
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    return np.append(first, n), words.text_index()[first]


def _windows(min_words: int):
    def run(batches):
        for batch in slices(batches):
            texts = Texts(batch.column("text"), lower=True)
            words = texts.words()
            if not len(words.starts):
                continue
            codes, distinct = words.coded()
            bounds, owner = _units(texts, words)
            n_words = np.diff(bounds)
            places = scramble(runs(n_words).astype(np.uint64)) | np.uint64(1)
            unit = scramble(np.add.reduceat(hashes(distinct)[codes] * places, bounds[:-1]))
            # The stretch from unit i ends with the unit that completes min_words words.
            stop = np.searchsorted(bounds, bounds[:-1] + min_words) - 1
            text_end = np.searchsorted(owner, owner, side="right")
            begin = np.flatnonzero((stop < text_end) & (bounds[:-1] + min_words <= bounds[-1]))
            stop = stop[begin]
            d1, d2 = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
            for k in range(int((stop - begin).max(initial=-1)) + 1):
                inside = begin + k <= stop
                value = unit[np.minimum(begin + k, len(unit) - 1)]
                d1 += np.where(inside, scramble(value + np.uint64(2 * k + 1)), np.uint64(0))
                d2 += np.where(inside, scramble(value ^ scramble(np.full(1, 77 + k, np.uint64))), np.uint64(0))
            # Byte offsets to code points of the text.
            points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            text = owner[begin]
            opening = points[texts.offsets[text]]
            at = points[words.starts[bounds[begin]]] - opening
            end = points[words.ends[bounds[stop + 1] - 1]] - opening
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), batch.column("doc_id").take(take),
                    batch.column("digest").take(take), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32)),
                ],
                names=[part.split(" ")[0] for part in WINDOWS.split(", ")],
            )

    return run


def _cut(batches):
    """Drop the spans: the table's texts with the removed stretches merged and cut out."""
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        merged_all, cut = [], []
        for text, found in zip(texts, spans):
            merged: list[list[int]] = []
            for span in sorted((s["at"], s["stop"]) for s in found or ()):
                if merged and span[0] <= merged[-1][1] + GAP:
                    merged[-1][1] = max(merged[-1][1], span[1])
                else:
                    merged.append(list(span))
            if merged:
                pieces, at = [], 0
                for begin, stop in merged:
                    pieces.append(text[at:begin])
                    at = stop
                text = "".join([*pieces, text[at:]])
            merged_all.append([{"start": a, "end": b} for a, b in merged])
            cut.append(text)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        removed = pa.array([sum(s["end"] - s["start"] for s in m) for m in merged_all], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(m) for m in merged_all], pa.int64()), removed,
             pa.array(merged_all, kind), pa.array(cut, pa.string())],
            names=["doc_id", "n_removed", "removed_chars", "removed", "text"],
        )


RESULT = "doc_id long, n_removed long, removed_chars long, removed array<struct<start:int,end:int>>, text string"


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, at, stop) of every stretch that is not the earliest of its digest."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("digest", F.xxhash64("text"))
    windows = rows.mapInArrow(_windows(min_words), WINDOWS)
    rank = F.struct("doc_id", "digest", "at")
    firsts = windows.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("d1", "d2", "first")
    found = windows.join(firsts, ["d1", "d2"])
    return found.where(~rank.eqNullSafe(F.col("first"))).select("doc_id", "digest", "at", "stop")


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per document: its text without repeated stretches, and what was removed."""
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "digest")
    spans = spans.agg(F.collect_set(F.struct("at", "stop")).alias("spans")).alias("s")
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("digest", F.xxhash64(text_of())).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.digest") == F.col("s.digest"))
    return rows.join(spans, same, "left").select("r.doc_id", "text", "spans").mapInArrow(_cut, RESULT)
