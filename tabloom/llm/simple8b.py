"""Simple-8b: whole numbers packed into 64-bit words, with escapes and blocks.

The low 4 bits of a word are its selector, the other 60 hold n numbers of w bits, low end
first. Selector 0 is an escape: the next word is one number of 60 bits or more. Numbers come
in blocks of `BLOCK`; a block starts with a new word, so its words are found by an offset and
all blocks are coded and decoded side by side. A block's last word may have unused places.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
ESCAPE = 0
#: selector - 1 -> (numbers in a word, bits of each).
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


def _short_bits() -> np.ndarray:
    width = np.ones(1 << 16, dtype=np.uint8)
    for bits in range(1, 16):
        width[1 << bits :] = bits + 1
    return width


SHORT_BITS = _short_bits()


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each number needs, 1 at least."""
    if not len(values) or values.max() < len(SHORT_BITS):
        return SHORT_BITS[values.astype(np.int64)]
    width = np.ones(len(values), dtype=np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = values >> np.uint64(shift)
        more = big > 0
        width[more] += shift
        values = np.where(more, big, values)
    return width


def _choices(width: np.ndarray) -> np.ndarray:
    """For each place, the selector of a word that starts there; `width` is padded by 60 ones."""
    n = len(width) - 60
    choice = np.zeros(n, dtype=np.uint8)
    left = np.ones(n, dtype=bool)
    # most[i]: the widest of the next `span` numbers, grown from few to many.
    fits = {}
    most, span = width.copy(), 1
    for count, bits in reversed(LAYOUTS):
        while span < count:
            grow = min(span, count - span)
            most = np.maximum(most[: len(most) - grow], most[grow:])
            span += grow
        fits[count] = most[:n] <= bits
    for selector, (count, _) in enumerate(LAYOUTS, 1):
        hit = left & fits[count]
        choice[hit] = selector
        left &= ~hit
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): block b is words[offsets[b]:offsets[b + 1]]."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # Blocks side by side; places beyond the end, and beyond a block, count as one bit wide.
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = values
    width = np.ones((blocks, BLOCK + 60), dtype=np.uint8)
    width[:, :BLOCK] = _bits(padded).reshape(blocks, BLOCK)
    choice = _choices(width.ravel() if blocks == 1 else np.append(width.ravel(), np.ones(60, np.uint8)))
    choice = choice[: blocks * (BLOCK + 60)] if blocks > 1 else np.append(choice, np.zeros(60, np.uint8))
    counts = np.array([1, *[c for c, _ in LAYOUTS]], dtype=np.int64)
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    used = np.zeros(blocks, dtype=np.int64)  # words of each block so far
    which, where, chosen, order = [], [], [], []
    while len(live):  # one word of every block a step
        selector = choice[live * (BLOCK + 60) + at[live]]
        which.append(live)
        where.append(at[live])
        chosen.append(selector)
        order.append(used[live])
        used[live] += 1 + (selector == ESCAPE)
        at[live] += counts[selector]
        live = live[at[live] < ends[live]]
    which, where, chosen, order = map(np.concatenate, (which, where, chosen, order))
    offsets = np.concatenate([[0], np.cumsum(used)])
    slot = offsets[which] + order
    words = np.zeros(int(offsets[-1]), dtype=np.uint64)
    words[slot] = chosen
    wide = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    wide[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    flat, start = wide.ravel(), which * (BLOCK + 60) + where
    words[slot[chosen == ESCAPE] + 1] = flat[start[chosen == ESCAPE]]
    for selector, (count, bits) in enumerate(LAYOUTS, 1):
        mine = chosen == selector
        source = start[mine]
        packed = np.full(len(source), selector, dtype=np.uint64)
        for k in range(count if len(source) else 0):
            packed |= flat[source + k] << np.uint64(4 + k * bits)
        words[slot[mine]] = packed
    return words, offsets


def _selectors(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each coded word, its selector); the word after an escape is no coded word."""
    selectors = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selectors == ESCAPE).any():  # rare: follow the words of the blocks that may have one
        for first, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if (selectors[first:stop] == ESCAPE).any():
                i = first
                while i < stop:
                    if selectors[i] == ESCAPE:
                        raw[i + 1] = True
                        i += 1
                    i += 1
    coded = np.flatnonzero(~raw)
    return coded, selectors[coded]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n numbers of consecutive blocks, all of them full but for the last."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    coded, selectors = _selectors(words, offsets)
    counts = np.array([1, *[c for c, _ in LAYOUTS]], dtype=np.int64)[selectors]
    block = np.searchsorted(offsets, coded, side="right") - 1
    upto = np.cumsum(counts) - counts
    opening = np.searchsorted(coded, offsets[:-1])
    at = upto - upto[opening][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    escape = selectors == ESCAPE
    out[at[escape]] = words[coded[escape] + 1]
    for selector, (count, bits) in enumerate(LAYOUTS, 1):
        mine = selectors == selector
        if not mine.any():
            continue
        value, to, end = words[coded[mine]] >> np.uint64(4), at[mine], limit[mine]
        mask, full = np.uint64((1 << bits) - 1), to + count <= end
        whole, whole_to = value[full], to[full]
        for k in range(count):
            out[whole_to + k] = (whole >> np.uint64(k * bits)) & mask
        value, to, end = value[~full], to[~full], end[~full]
        for k in range(count if len(to) else 0):
            inside = to + k < end
            out[(to + k)[inside]] = (value[inside] >> np.uint64(k * bits)) & mask
    return out
