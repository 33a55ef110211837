"""Words and lines of an Arrow column of texts, as numpy arrays over its UTF-8 bytes.

Words are maximal runs outside of space and U+0009 to U+000D. All separators are single bytes
that never occur inside a UTF-8 sequence, so no text is decoded. One call handles one slice of
a batch; `slices` bounds its bytes (a longer text is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = 0x0A


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator:
    """The batches, cut so that the column holds about `limit` bytes in each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


class Texts:
    """The bytes of all texts, each followed by a line break, and where each one starts."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.type != pa.binary():
            column = pc.cast(column, pa.binary())
        column = pc.fill_null(column, b"")
        size = pa.scalar(b"\n", pa.binary())
        joined = pc.binary_join_element_wise(column, pa.scalar(b"", pa.binary()), size)
        offsets = np.frombuffer(joined.buffers()[1], dtype=np.int32)[joined.offset : joined.offset + len(joined) + 1]
        raw = joined.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets.astype(np.int64) - int(offsets[0])
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + upper.view(np.uint8) * np.uint8(32)
        self.n = len(column)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask names."""
        if not len(mask):
            return np.zeros(self.n, np.int64)
        return np.add.reduceat(mask, self.offsets[:-1], dtype=np.int64)

    def words(self) -> Words:
        return Words(self)


class Words:
    """starts, ends: the words' bytes; first: index of the first word of each text, and the end."""

    def __init__(self, texts: Texts):
        self.inside = ~SEPARATOR[texts.data]
        edges = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if len(self.inside) and self.inside[0]:
            edges = np.concatenate([[0], edges])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, texts.offsets)
        self.texts = texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word and the distinct words; equal numbers mean equal bytes."""
        offsets = np.zeros(len(self.starts) + 1, dtype=np.int32)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        data = self.texts.data[self.inside]
        strings = pa.Array.from_buffers(
            pa.binary(), len(self.starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
        )
        encoded = strings.dictionary_encode()
        return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary.to_pylist()


def hashes(values: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each value."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values), dtype=np.uint64, count=len(values))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours; entry i covers i .. i + width - 1."""
    out = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width if len(out) else 0):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return scramble(out)


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """An Arrow list column whose k-th entry takes the next counts[k] values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
