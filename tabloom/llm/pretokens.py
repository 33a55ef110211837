"""Split texts into the pre-tokens of the byte-level vocabularies, a slice of a batch at a time.

The pattern (contractions, ` ?letters`, ` ?digits`, ` ?others`, white space) depends on the class
of each character only, so its matches are found with array operations: a pre-token starts at
every change of class, a single space goes with what follows it, and `'s`-like endings are
joined. Distinct pre-tokens are encoded once a slice; ids are then gathered by index.

Classes come from Unicode tables; libraries differ there on recently added characters, so a
text with characters outside of long-stable ranges is left to the library as a whole.
"""

from __future__ import annotations

import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tabloom.llm.process import once

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Beyond it are no letters or digits: planes 4 to 13 are empty, 14 has marks and tags, 15 and 16 are private.
LAST_CLASSED = 0x40000
#: Ranges whose classes are the same in all Unicode versions in use.
STABLE = ((0x0, 0x376), (0x384, 0x528), (0x2000, 0x2065), (0x3041, 0x30FF), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for code in range(LAST_CLASSED):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = LETTER if kind == "L" else DIGIT
    table[WHITE] = SPACE
    return table


def _stable_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for first, stop in STABLE:
        table[first:stop] = True
    return table


class Pretokens:
    """first: index of the first pre-token of each text; codes and distinct: what they are.

    words: which of the distinct ones are a space and letters.
    """

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        starts = _starts(points, bounds[:-1][lengths > 0])
        self.first = np.searchsorted(starts, bounds)
        # A character beyond ASCII takes one to three bytes more; those are few.
        odd = np.flatnonzero(points >= 0x80)
        more = 1 + (points[odd] >= 0x800).astype(np.int64) + (points[odd] >= 0x10000)
        more = np.concatenate([[0], np.cumsum(more)])
        at = np.append(starts, len(points))
        offsets = (at + more[np.searchsorted(odd, at)]).astype(np.int32)
        array = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined.encode())]
        )
        encoded = array.dictionary_encode()
        self.codes = encoded.indices.to_numpy().astype(np.int64)
        self.distinct: list[bytes] = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        seen = np.zeros(len(self.distinct), dtype=np.int64)
        seen[self.codes] = np.arange(len(starts))
        second = np.minimum(starts[seen] + 1, max(len(points) - 1, 0))
        longer = at[seen + 1] - at[seen] > 1
        self.words = longer & (points[second - 1] == 0x20) & (once("classes", _class_table)[points[second]] == LETTER)


def _starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, over the characters of all texts together."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kinds = once("classes", _class_table)[points]
    opens = np.zeros(n + 1, dtype=bool)  # starts of texts, and the end
    opens[text_starts] = True
    opens[n] = True
    change = opens.copy()
    change[1:n] |= kinds[1:] != kinds[:-1]
    begin = np.flatnonzero(change[:n])
    end = np.append(begin[1:], n)
    kind = kinds[begin]
    start = change[:n]
    # A run after white space of the same text: its last white character is split off or joined.
    follows = np.zeros(len(begin), dtype=bool)
    follows[1:] = (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[begin[1:]]
    at = begin[follows]
    start[at - 1] = True
    joined = np.zeros(len(begin), dtype=bool)
    joined[follows] = points[at - 1] == 0x20
    start[begin[joined]] = False
    # A lone apostrophe that starts a pre-token takes one of the endings from the letters after it.
    mark = (points[begin] == 0x27) & (end - begin == 1) & ~joined
    mark[:-1] &= (kind[1:] == LETTER) & ~opens[begin[1:]]
    mark[-1] = False
    at = begin[mark] + 1
    room = end[np.flatnonzero(mark) + 1] - at
    taken = np.zeros(len(at), dtype=np.int64)
    for ending in reversed(ENDINGS):
        fits = room >= len(ending)
        for k, letter in enumerate(ending):
            fits &= points[np.minimum(at + k, n - 1)] == ord(letter)
        taken[fits] = len(ending)
    at, room, taken = at[taken > 0], room[taken > 0], taken[taken > 0]
    start[at] = False
    rest = (at + taken)[room > taken]
    start[rest] = True
    return np.flatnonzero(start)


def stable_texts(texts: list[str]) -> np.ndarray:
    """Which texts hold characters of the stable ranges only."""
    out, stable = np.ones(len(texts), dtype=bool), once("stable", _stable_table)
    for i, text in enumerate(texts):
        if not text.isascii():
            out[i] = stable[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].all()
    return out


def gather(codes: np.ndarray, pool: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of a sequence of codes, when code c owns the next sizes[c] entries of the pool."""
    opening = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(opening[codes] - (ends - counts), counts) + np.arange(total)]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, all entries) of lists of ids."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(sizes.sum()))


def encode_texts(texts: list[str], encode_distinct, encode_whole, special: tuple[str, ...] = ()):
    """(ids of all texts, number of ids of each text).

    `encode_distinct` maps the distinct pre-tokens of a `Pretokens` to (number of ids of each, all
    their ids); `encode_whole` does a text that holds a special token or characters outside of
    the stable ranges.
    """
    plain = stable_texts(texts)
    for i, text in enumerate(texts):
        if plain[i] and any(s in text for s in special):
            plain[i] = False
    split = Pretokens([t if ok else "" for t, ok in zip(texts, plain)])
    sizes, pool = encode_distinct(split)
    whole = [encode_whole(texts[i]) for i in np.flatnonzero(~plain)]
    more, ids = flat(whole)
    sizes, pool = np.concatenate([sizes, more]), np.concatenate([pool, ids])
    # A whole text is one more code, at the place of that text.
    odd = np.flatnonzero(~plain)
    codes = np.insert(split.codes, split.first[odd], len(split.distinct) + np.arange(len(odd)))
    first = split.first + np.concatenate([[0], np.cumsum(~plain)])
    ids = gather(codes, pool, sizes)
    upto = np.concatenate([[0], np.cumsum(sizes[codes])])
    return ids, np.diff(upto[first])


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()
