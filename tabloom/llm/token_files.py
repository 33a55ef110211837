"""Operator 5, token-id files: Simple-8b blocks in ascending doc_id order.

Documents are range-partitioned and sorted by doc_id; each task encodes its range and streams
one file to the shared folder, so a task holds a slice of texts at a time. A file is: blocks
of coded words; then the doc_ids (int64) and id counts (int64) of its documents, the word
offset of each block (int64); then a footer of four int64 (documents, ids, blocks, words) and
a magic number. All numbers are little-endian. The manifest names the files of successful
attempts with their place in the order; other files are never read. A prefix sum over the
manifest gives each file's first global position. Readers decode a bounded run of blocks at a
time.

Defined results: a null text counts as empty and still has the end id; null ids come first;
rows with equal ids are ordered by their text; an empty table has no files and no rows.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm import simple8b
from tabloom.llm.files import open_folder, own_name
from tabloom.llm.pretokens import Pretokens, encode_texts, flat, gather, texts_of
from tabloom.llm.process import once
from tabloom.llm.shared import stored, text_of
from tabloom.llm.words import slices
from tabloom.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
FILE_BYTES = 32 << 20
READ_BLOCKS = 1024
KNOWN_PRETOKENS = 800_000
JOINED_WORDS = 5_000
MAGIC = b"SIMPLE8B"

MANIFEST = "range int, file string, first_doc long, documents long, ids long"


class Encoder:
    """The library's encoder; the ids of up to `KNOWN_PRETOKENS` pre-tokens are remembered.

    A memory that is full starts anew with the pre-tokens of the present slice. New pre-tokens
    that are a space and letters are given to the library side by side, as one text: it splits
    them at the spaces, and as only their first piece can begin with a space, the pieces tell
    where each one starts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        size = self.tokenizer.get_vocab_size()
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(size)])

    def _forget(self) -> None:
        #: pre-token -> its place in `sizes`; `pool` has the ids of all in this order.
        self.known: dict[bytes, int] = {}
        self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self._batch([b"".join(words).decode()])[0], dtype=np.uint32)
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) != len(words):
            return flat(self._batch([w.decode() for w in words]))
        return np.diff(np.append(starts, len(ids))), ids

    def _fresh(self, pretokens: list[bytes], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens from the library: first the words, then the others."""
        together = [pretokens[i] for i in np.flatnonzero(words)]
        parts = [self._words(together[at : at + JOINED_WORDS]) for at in range(0, len(together), JOINED_WORDS)]
        parts.append(flat(self._batch([pretokens[i].decode() for i in np.flatnonzero(~words)])))
        sizes, pool = (np.concatenate(x) for x in zip(*parts))
        order = np.concatenate([np.flatnonzero(words), np.flatnonzero(~words)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return sizes[place], gather(place, pool, sizes)

    def encode_pretokens(self, split: Pretokens) -> tuple[np.ndarray, np.ndarray]:
        distinct = split.distinct
        places = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        pretokens = [distinct[i] for i in new]
        sizes, pool = self._fresh(pretokens, split.words[new])
        places[new] = len(self.sizes) + np.arange(len(new))
        all_sizes, all_ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, pool])
        out = all_sizes[places], gather(places, all_ids, all_sizes)
        if len(self.known) + len(new) <= KNOWN_PRETOKENS:
            self.known.update(zip(pretokens, range(len(self.sizes), len(all_sizes))))
            self.sizes, self.pool = all_sizes, all_ids
        elif len(distinct) <= KNOWN_PRETOKENS:
            self.known = dict(zip(distinct, range(len(distinct))))
            self.sizes, self.pool = out
        else:
            self._forget()
        return out

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id, and how many each has)."""
        ids, counts = encode_texts(texts, self.encode_pretokens, self.encode_whole, self.special)
        return np.insert(ids, np.cumsum(counts), END_ID), counts + 1


def encoder(path: str) -> Encoder:
    return once(("encoder", path), lambda: Encoder(path))


class Writer:
    """Streams blocks to a file and ends it with the index."""

    def __init__(self, file):
        self.file, self.rest = file, np.zeros(0, np.uint64)
        self.doc_ids, self.counts, self.offsets = [], [], [np.zeros(1, np.int64)]
        self.ids = self.words = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<i8"))
        self.ids += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(self.rest) // simple8b.BLOCK * simple8b.BLOCK
        self._write(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _write(self, ids: np.ndarray) -> None:
        if len(ids):
            words, offsets = simple8b.encode(ids)
            self.file.write(words.astype("<u8").tobytes())
            self.offsets.append(offsets[1:] + self.words)
            self.words += len(words)

    def close(self) -> None:
        self._write(self.rest)
        offsets = np.concatenate(self.offsets).astype("<i8")
        for part in (*self.doc_ids, *self.counts, offsets):
            self.file.write(part.tobytes())
        numbers = [sum(map(len, self.doc_ids)), self.ids, len(offsets) - 1, self.words]
        self.file.write(np.array(numbers, dtype="<i8").tobytes() + MAGIC)
        self.file.close()


class Reader:
    """The index of a file, and its ids by runs of blocks."""

    def __init__(self, file):
        self.file, end = file, file.size()
        file.seek(end - 40)
        tail = file.read(40)
        if tail[32:] != MAGIC:
            raise ValueError("not a token file")
        documents, self.ids, self.blocks, self.words = np.frombuffer(tail[:32], dtype="<i8").tolist()
        file.seek(self.words * 8)
        index = np.frombuffer(file.read(end - 40 - self.words * 8), dtype="<i8")
        self.doc_ids, self.counts = index[:documents], index[documents : 2 * documents]
        self.offsets = index[2 * documents :]

    def runs(self, blocks: int = READ_BLOCKS):
        """The ids in order, `blocks` blocks at a time."""
        for first in range(0, self.blocks, blocks):
            stop = min(first + blocks, self.blocks)
            offsets = self.offsets[first : stop + 1]
            self.file.seek(int(offsets[0]) * 8)
            words = np.frombuffer(self.file.read(int(offsets[-1] - offsets[0]) * 8), dtype="<u8")
            n = min(stop * simple8b.BLOCK, self.ids) - first * simple8b.BLOCK
            yield simple8b.decode(words, offsets - offsets[0], n)


def _write(folder: str, vocabulary: str):
    def run(batches):
        writer, number, name = None, None, None
        for batch in slices(batches, limit=4 << 20):
            if writer is None:
                system, path = open_folder(folder)
                number = batch.column("range")[0].as_py()
                name = own_name(f"tokens-{number:06d}", ".s8b")
                writer = Writer(system.open_output_stream(f"{path}/{name}"))
            ids, counts = encoder(vocabulary).encode(texts_of(batch.column("text")))
            # A null id is written as the least number.
            doc_ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            writer.add(doc_ids, ids, counts)
        if writer is not None:
            writer.close()
            documents = sum(map(len, writer.doc_ids))
            row = ([number], [name], [int(writer.doc_ids[0][0])], [documents], [writer.ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=[part.split(" ")[0] for part in MANIFEST.split(", ")],
            )

    return run


def write_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents; the stored manifest has a row for each file, in order by `range`."""
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // file_bytes))
    ordered = rows.repartitionByRange(ranges, F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    numbered = ordered.withColumn("range", F.spark_partition_id())
    manifest = stored(numbered.mapInArrow(_write(folder, vocabulary), MANIFEST), "manifest")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                system, path = open_folder(folder)
                with system.open_input_file(f"{path}/{name}") as file:
                    reader = Reader(file)
                    crcs = _checksums(reader)
                    starts = start + np.cumsum(reader.counts) - reader.counts
                    null = reader.doc_ids == -(1 << 63)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=null), pa.array(starts), pa.array(reader.counts), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def _checksums(reader: Reader) -> np.ndarray:
    """The crc32 of each document's ids; a document may span runs of blocks."""
    crcs = np.zeros(len(reader.counts), dtype=np.int64)
    ends = np.cumsum(reader.counts).tolist()
    at, k = 0, 0
    for ids in reader.runs():
        raw, stop, begin = memoryview(ids.astype("<u4").tobytes()), at + len(ids), at
        while k < len(ends):
            upto = min(ends[k], stop)
            crcs[k] = zlib.crc32(raw[(at - begin) * 4 : (upto - begin) * 4], int(crcs[k]))
            at = upto
            if ends[k] > stop:
                break
            k += 1
    return crcs


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    files = max(1, manifest.count())
    return manifest.repartition(files, "range").select("file", "start").mapInArrow(_read(folder), RESULT)


def token_files(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the files (to a new shared folder by default), and read them back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_files(stored(write_files(docs, folder, vocabulary), "files"), folder)
