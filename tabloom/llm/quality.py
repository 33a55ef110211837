"""Operator 2, quality rules: how many documents of a host share a line.

One pass over the texts gives each document its counts and, for each line that has a word, a
digest of the line's lower-cased words. Copies of a text count as one document of their host:
distinct (host, lines) pairs are exploded to distinct (host, line) and counted, combined on
the map side. A line is frequent if more than `min_documents` of the host's distinct documents
have it, however many there are (a caller may ask for a `share` of them as well); frequent lines
are removed, and a document that keeps less than `keep_words` of its words is depleted and
rejected, as is one that fails the base rules.

Defined results: a null or empty text has no words and fails the base rules; a null host is a
host; rows equal in id and text get the same result; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import small_lists, small_side, stored, text_of
from tabloom.llm.words import NEWLINE, Texts, hashes, lists, runs, scramble, slices, window_hashes

MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
MIN_DOCUMENTS = 20
#: A share would let the limit grow with the host and keep the lines that a large one repeats.
SHARE = 0.0
KEEP_WORDS = 0.3

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

FEATURES = (
    "doc_id long, host string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<long>, line_words array<int>, line_at array<int>"
)


def _repeated_words(codes: np.ndarray, digests: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, its words inside an 8-word window that occurs twice or more in it."""
    counts, n = np.diff(first), len(codes)
    owner = np.repeat(np.arange(len(counts)), counts)
    keys = window_hashes(digests[codes], WINDOW)
    keys ^= scramble(owner[: len(keys)].astype(np.uint64) + np.uint64(1))
    valid = np.flatnonzero(np.repeat(first[1:], counts)[: len(keys)] - np.arange(len(keys)) >= WINDOW)
    ordered = np.sort(keys[valid])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(counts), np.int64)
    at = np.searchsorted(twice, keys[valid])
    hit = valid[twice[np.minimum(at, len(twice) - 1)] == keys[valid]]
    covered = np.zeros(n + 1, dtype=np.int32)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + WINDOW, -1)
    marked = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return marked[first[1:]] - marked[first[:-1]]


def _line_table(texts: Texts, words, codes, folded: np.ndarray):
    """Lines that have a word: text, digest, words, whether an earlier one is equal, number."""
    ends = np.flatnonzero(texts.data == NEWLINE) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    cuts = np.searchsorted(words.starts, np.append(starts, len(texts.data)))
    n_words = np.diff(cuts)
    full = np.flatnonzero(n_words)
    raw = pa.Array.from_buffers(
        pa.binary(), len(ends),
        [None, pa.py_buffer(np.append(starts, len(texts.data)).astype(np.int32).tobytes()), pa.py_buffer(texts.data.tobytes())],
    )
    same = raw.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    owner = np.searchsorted(texts.offsets, starts[full], side="right") - 1
    n_words = n_words[full]
    keys = owner * (len(ends) + 1) + same
    _, firsts = np.unique(keys, return_index=True)
    repeated = np.ones(len(full), dtype=bool)
    repeated[firsts] = False
    if not len(full):
        return owner, np.zeros(0, np.uint64), n_words, repeated, full
    # The order of the words counts: each digest is multiplied by a hash of its place.
    placed = folded[codes] * (scramble(runs(n_words).astype(np.uint64)) | np.uint64(1))
    digest = scramble(np.add.reduceat(placed, np.concatenate([[0], np.cumsum(n_words)[:-1]])))
    return owner, digest, n_words, repeated, full - np.searchsorted(starts, texts.offsets[:-1])[owner]


def _features(batches):
    for batch in slices(batches):
        texts = Texts(batch.column("text"))
        words = texts.words()
        codes, distinct = words.coded()
        owner, digest, n_words, repeated, at = _line_table(texts, words, codes, hashes([w.lower() for w in distinct]))
        per_text = lambda weights: np.bincount(owner, weights=weights, minlength=texts.n).astype(np.int64)
        line_counts = np.bincount(owner, minlength=texts.n)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("host"), batch.column("digest"),
                pa.array(words.counts.astype(np.int64)),
                pa.array(texts.per_text(words.inside & ((texts.data & 0xC0) != 0x80))),
                pa.array(texts.per_text(SYMBOL[texts.data])),
                pa.array(per_text(repeated)),
                pa.array(_repeated_words(codes, hashes(distinct), words.first)),
                lists(line_counts, pa.array(digest.view(np.int64))),
                lists(line_counts, pa.array(n_words.astype(np.int32))),
                lists(line_counts, pa.array(at.astype(np.int32))),
            ],
            names=[part.split(" ")[0] for part in FEATURES.split(", ")],
        )


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts of each document and the digests of its lines, as a stored table."""
    chosen = docs.select(
        F.col("doc_id").cast("long"), F.col(host).cast("string").alias("host"),
        F.xxhash64(text_of()).alias("digest"), text_of().alias("text"),
    )
    return stored(chosen.mapInArrow(_features, FEATURES), "lines")


def frequent_lines(found: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(host, line, documents): the lines above the limits, as a stored table."""
    distinct = found.groupBy("host", F.array_distinct("lines").alias("lines")).agg(F.count(F.lit(1)))
    distinct = stored(distinct.select("host", "lines"), "distinct")
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    counts = (
        distinct.select("host", F.explode("lines").alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") > min_documents)
    )
    same_host = F.col("c.host").eqNullSafe(F.col("s.host"))
    joined = counts.alias("c").join(small_side(stored(sizes, "hosts")).alias("s"), same_host)
    above = joined.where(F.col("documents") > F.lit(share) * F.col("host_documents"))
    return stored(above.select("c.host", "line", "documents"), "frequent")


def verdicts(docs: DataFrame, host: str = "source", keep_words: float = KEEP_WORDS, **limits) -> DataFrame:
    """A row per document: its counts, words removed with frequent lines, the verdict, lines.

    `removed_lines` has the numbers (from 0) of the lines that are removed.
    """
    found = features(docs, host)
    frequent = small_side(frequent_lines(found, **limits))
    lines = found.select(
        "doc_id", "digest", F.col("host").alias("h"), F.explode(F.arrays_zip("lines", "line_words", "line_at")).alias("l")
    ).select("doc_id", "digest", "h", "l.lines", "l.line_words", F.col("l.line_at").alias("at"))
    hit = lines.join(frequent, (F.col("lines") == F.col("line")) & F.col("h").eqNullSafe(F.col("host")))
    # Rows equal in id and text bring the same lines; each place counts once.
    hit = hit.groupBy("doc_id", "digest", "h", "at").agg(F.max("line_words").alias("words"))
    removed = hit.groupBy("doc_id", "digest", "h").agg(
        F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines")
    )
    removed = small_lists(stored(removed, "removed")).alias("r")
    same = (
        F.col("f.doc_id").eqNullSafe(F.col("r.doc_id"))
        & (F.col("f.digest") == F.col("r.digest"))
        & F.col("f.host").eqNullSafe(F.col("r.h"))
    )
    rows = found.alias("f").join(removed, same, "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = F.coalesce("removed_words", F.lit(0)).cast("long")
    return rows.select(
        "f.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), lost.alias("removed_words"),
        (~failed & (F.col("n_words") - lost >= F.lit(keep_words) * F.col("n_words"))).alias("kept"),
        "f.digest", "f.host", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def quality_rules(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that pass, without their frequent lines, in the columns of `docs`."""
    verdict = stored(verdicts(docs, host, **limits), "verdicts")
    touched = verdict.where(~F.col("kept") | (F.size("removed_lines") > 0))
    touched = touched.select("doc_id", "digest", "host", "kept", "removed_lines").distinct()
    touched = small_lists(stored(touched, "touched")).alias("t")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"),
        F.xxhash64(text_of()).alias("_digest"), F.col(host).cast("string").alias("_host"),
    ).alias("d")
    same = (
        F.col("_id").eqNullSafe(F.col("t.doc_id"))
        & (F.col("_digest") == F.col("t.digest"))
        & F.col("_host").eqNullSafe(F.col("t.host"))
    )
    left = rows.join(touched, same, "left").where(F.coalesce("t.kept", F.lit(True)))
    lines = F.filter(F.split("row.text", "\n"), lambda _, at: ~F.array_contains("t.removed_lines", at))
    new = F.when(F.size("t.removed_lines") > 0, F.array_join(lines, "\n")).otherwise(F.col("row.text"))
    out = left.select("row", new.alias("_text"))
    columns = []
    for field in docs.columns:
        if field == "text":
            columns.append(F.col("_text").alias(field))
        elif field == "n_chars":
            changed = F.length("_text").cast(docs.schema[field].dataType)
            columns.append(F.when(F.col("_text") == F.col("row.text"), F.col("row.n_chars")).otherwise(changed).alias(field))
        else:
            columns.append(F.col("row").getField(field).alias(field))
    return out.select(*columns)
