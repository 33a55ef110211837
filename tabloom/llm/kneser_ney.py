"""Operator 4, LM scoring: an interpolated modified Kneser-Ney model in sorted hash arrays.

Counting runs in Spark. A task turns a slice of texts into its distinct n-grams with counts,
dealt to shards by their own hash, so the n-grams of a common context go to all shards. A
shard's reducer adds them up, writes its arrays (sorted n-gram hashes with counts) to the shared
folder, passes the n-grams of the next lower order on, counted by their distinct left neighbours,
and gives a partial sum for each context. A second grouping by the hash of the context adds these
up and writes sorted context hashes with their totals. The driver sees one row a file: names and
counts of counts, from which the discounts follow.

Scoring tasks memory-map the shard files, look up the distinct n-grams of a slice in hash
order and add up logarithms by text. Where the shared folder is no mounted path, one shard at
a time is read instead. Nothing is broadcast; the model grows with the distinct n-grams.

A text is its words (runs outside of space and U+0009 to U+000D, A-Z folded) and one end mark,
behind order - 1 start marks. Words are 64-bit hashes. A stored count is one byte, or an escape.
In the files an n-gram or context is the leading bits of its hash, which a table of buckets
gives, and 32 bits more: one of some 2^28 unknown n-grams passes for a known one. Single words
keep all 64 bits. Counts of n-grams that begin with a start mark stay raw at every order.
Unigrams are interpolated with the uniform distribution over the vocabulary and one unknown word.
If the counts of counts of an order give no discounts, 0.5, 1 and 1.5 are used.

Defined results: a null text counts as empty and is its end mark alone; a null id is not held
out; without training rows every probability is uniform; rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.files import open_folder, own_name
from tabloom.llm.process import once
from tabloom.llm.shared import stored, text_of
from tabloom.llm.words import Texts, hashes, scramble, slices
from tabloom.session import scratch_path

ORDER = 2
SHARD_BYTES = 12 << 20
COUNT_BYTES, SCORE_BYTES = 8 << 20, 4 << 20
HELD_OUT = (7, 2)
FALLBACK = (0.5, 1.0, 1.5)
ESCAPE, BUCKET = 255, 16
#: Hashes of marks that hold a separator, which no word does.
START, END = (int(h) for h in hashes([b"<s>\n", b"</s>\n"]))

GRAMS = "shard int, grams binary, adjusted binary, raw binary"
CONTEXT_FILES = "ngram int, shard int, file string, contexts long"
FILES = "ngram int, shard int, file string, grams long, total long, raw long, n1 long, n2 long, n3 long, n4 long, types long"


def _sequence(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of all marks and words, places of the tokens, number of texts); texts in a row."""
    texts = Texts(column, lower=True)
    words = texts.words()
    codes, distinct = words.coded()
    values = np.insert(hashes(distinct)[codes], words.first[1:], np.uint64(END))
    starts = words.first[:-1] + np.arange(texts.n)
    sequence = np.insert(values, np.repeat(starts, order - 1), np.uint64(START))
    lengths = words.counts + 1
    pad = (np.arange(texts.n) + 1) * (order - 1)
    return sequence, np.arange(len(values)) + np.repeat(pad, lengths), lengths


def _context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """The hash of a context; an empty one is left to the caller."""
    out = scramble(columns[0])
    for column in columns[1:]:
        out = scramble(out * np.uint64(3) + column)
    return out


def _gram_hash(context: np.ndarray | None, last: np.ndarray) -> np.ndarray:
    return scramble(last) if context is None else scramble(context * np.uint64(5) + last)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(33)) % np.uint64(shards)


def _merge(columns: list[np.ndarray], adjusted: np.ndarray, raw: np.ndarray):
    """Equal n-grams added up, in the order of (context hash, last word)."""
    context = _context_hash(columns[:-1]) if len(columns) > 1 else None
    order = np.lexsort((columns[-1], context)) if context is not None else np.argsort(columns[-1], kind="stable")
    columns = [c[order] for c in columns]
    context = context[order] if context is not None else None
    new = np.ones(len(order), dtype=bool)
    new[1:] = columns[-1][1:] != columns[-1][:-1]
    if context is not None:
        new[1:] |= context[1:] != context[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return columns, context, adjusted, raw
    add = lambda x: np.add.reduceat(x[order].astype(np.int64), first)
    return [c[first] for c in columns], context[first] if context is not None else None, add(adjusted), add(raw)


def pack(values: np.ndarray) -> bytes:
    """Counts, a byte each; larger ones are an escape, and follow at the end in 64 bits."""
    values = np.asarray(values, dtype=np.int64).ravel()
    return np.minimum(values, ESCAPE).astype(np.uint8).tobytes() + values[values >= ESCAPE].astype("<i8").tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    values[values == ESCAPE] = np.frombuffer(raw, "<i8", offset=n)
    return values


def _dealt(columns, context, adjusted, raw, shards: int) -> pa.RecordBatch:
    """A row for each shard that gets some of the n-grams; a context's n-grams go to many.

    At the highest order the adjusted counts are the raw ones and left out.
    """
    shard = _shard(_gram_hash(context, columns[-1]), shards)
    order = np.argsort(shard, kind="stable")
    numbers, first = np.unique(shard[order], return_index=True)
    bounds = np.append(first, len(order)).tolist()
    rows = ([], [], [], [])
    for number, a, b in zip(numbers.tolist(), bounds[:-1], bounds[1:]):
        mine = order[a:b]
        rows[0].append(number)
        rows[1].append(b"".join(c[mine].tobytes() for c in columns))
        rows[2].append(None if adjusted is None else pack(adjusted[mine]))
        rows[3].append(pack(raw[mine]))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(rows, kinds)], names=["shard", "grams", "adjusted", "raw"]
    )


def _count(order: int, shards: int):
    def run(batches):
        for batch in slices(batches, limit=COUNT_BYTES):
            sequence, at, _ = _sequence(batch.column("text"), order)
            columns = [sequence[at - back] for back in range(order - 1, -1, -1)]
            ones = np.ones(len(at), dtype=np.int64)
            columns, context, counts, _ = _merge(columns, ones, ones)
            yield _dealt(columns, context, None, counts, shards)

    return run


def _reduce(order: int, top: bool, shards: int, folder: str):
    """Add up a shard, write its file, and give (its row of FILES, its n-grams of order - 1)."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for grams, adjusted, raw in zip(*(table.column(c).to_pylist() for c in ("grams", "adjusted", "raw"))):
            columns = np.frombuffer(grams, np.uint64).reshape(order, -1)
            raw = unpack(raw, columns.shape[1])
            parts.append((columns, raw if adjusted is None else unpack(adjusted, len(raw)), raw))
        columns = [np.concatenate([p[0][k] for p in parts]) for k in range(order)]
        adjusted, raw = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
        del parts
        columns, context, adjusted, raw = _merge(columns, adjusted, raw)
        number = int(table.column("shard")[0].as_py())
        keys = _gram_hash(context, columns[-1])
        sort = np.argsort(keys)
        counts = [adjusted[sort]] + [raw[sort]] * (order == 1)
        name = _write(folder, f"order{order}-{number:06d}", packed(keys[sort], counts, short=order > 1))
        row = [order, number, name, len(keys), int(adjusted.sum()), int(raw.sum())]
        row += [int((adjusted == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
        names = [part.split(" ")[0] for part in FILES.split(", ")]
        given = ("lower", "grams_below", "adjusted", "raw_below", "owner", "contexts", "sums")
        out = {n: [v] for n, v in zip(names, row)} | {key: [None] for key in given}
        if order > 1:
            # Each n-gram is one left neighbour of its suffix, unless the suffix opens a text.
            below = columns[1:]
            left = np.where(below[0] == np.uint64(START), raw, 1) if order > 2 else np.ones(len(raw), np.int64)
            below, below_context, left, below_raw = _merge(below, left, raw)
            dealt = _dealt(below, below_context, left, below_raw, shards).to_pydict()
            found = dict(zip(given, (dealt["shard"], dealt["grams"], dealt["adjusted"], dealt["raw"])))
            found |= dict(zip(given[4:], _partial_sums(context, adjusted, shards)))
            for some in (given[:4], given[4:]):
                n = len(found[some[0]])
                for key in out:
                    out[key] += found[key] if key in some else [None] * n
        return pa.table(out, schema=_reduced_schema())

    return run


def _write(folder: str, label: str, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other; the name of the file."""
    system, path = open_folder(folder)
    name = own_name(label, ".lm")
    with system.open_output_stream(f"{path}/{name}") as file:
        for array in arrays:
            file.write(array.tobytes())
    return name


def _partial_sums(context: np.ndarray, adjusted: np.ndarray, shards: int) -> tuple[list, list, list]:
    """(shard, contexts, sums): what sorted n-grams add to total, N1, N2 and N3+ of their contexts."""
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    parts = (adjusted, adjusted == 1, adjusted == 2, adjusted > 2)
    sums = np.stack([np.add.reduceat(m.astype(np.int64), first) for m in parts])
    keys = context[first]
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    numbers, begin = np.unique(shard[order], return_index=True)
    cuts = np.split(order, begin[1:])
    return numbers.tolist(), [keys[c].tobytes() for c in cuts], [pack(sums[:, c]) for c in cuts]


def _context_file(order: int, folder: str):
    """Add up the partial sums of a shard's contexts and write their file."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(k, np.uint64) for k in table.column("contexts").to_pylist()]
        sums = [unpack(v, 4 * len(k)).reshape(4, -1) for k, v in zip(parts, table.column("sums").to_pylist())]
        keys, sums = np.concatenate(parts), np.concatenate(sums, axis=1)
        sort = np.argsort(keys, kind="stable")
        keys, sums = keys[sort], sums[:, sort]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(sums, first, axis=1)
        number = int(table.column("shard")[0].as_py())
        arrays = packed(keys[first], list(sums), short=True)
        row = [order, number, _write(folder, f"contexts{order}-{number:06d}", arrays), len(first)]
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        names = [part.split(" ")[0] for part in CONTEXT_FILES.split(", ")]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds)})

    return run


REDUCED = FILES + ", lower int, grams_below binary, adjusted binary, raw_below binary, owner int, contexts binary, sums binary"


def _reduced_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in REDUCED.split(", "))])


def train(texts: DataFrame, order: int = ORDER, folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> dict:
    """Count the column `text` and write the model; returns its folder, files and discounts."""
    spark = texts.sparkSession
    folder = folder or scratch_path(spark, "ngrams")
    size = texts.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    grams = texts.select("text").mapInArrow(_count(order, shards), GRAMS)
    files, context_files = [], []
    for n in range(order, 0, -1):
        reduce = _reduce(n, n == order, shards, folder)
        reduced = stored(grams.groupBy("shard").applyInArrow(reduce, REDUCED), f"order{n}")
        files += reduced.where("file is not null").select(*[p.split(" ")[0] for p in FILES.split(", ")]).collect()
        if n > 1:
            sums = reduced.where("owner is not null").select(F.col("owner").alias("shard"), "contexts", "sums")
            context_files += sums.groupBy("shard").applyInArrow(_context_file(n, folder), CONTEXT_FILES).collect()
        grams = reduced.where("lower is not null").select(
            F.col("lower").alias("shard"), F.col("grams_below").alias("grams"), "adjusted", F.col("raw_below").alias("raw")
        )
    model = {"folder": folder, "order": order, "shards": shards, "files": {}, "contexts": {}, "discounts": {}}
    for n in range(1, order + 1):
        rows = [f for f in files if f["ngram"] == n]
        model["files"][n] = {f["shard"]: f["file"] for f in rows}
        model["contexts"][n] = {f["shard"]: f["file"] for f in context_files if f["ngram"] == n}
        n1, n2, n3, n4 = (sum(f[k] for f in rows) for k in ("n1", "n2", "n3", "n4"))
        model["discounts"][n] = discounts(n1, n2, n3, n4)
        if n == 1:
            types, total = (sum(f[k] for f in rows) for k in ("types", "total"))
            model |= {"vocabulary": types, "total": total, "tokens": sum(f["raw"] for f in rows)}
            model["often"] = (n1, n2, types - n1 - n2)
    return model


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more."""
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < d < k for k, d in enumerate(found, 1)):
            return found
    return FALLBACK


def packed(keys: np.ndarray, columns: list[np.ndarray], short: bool) -> list[np.ndarray]:
    """The arrays of a file: sorted keys with counts.

    Short keys stand in 2^bits buckets of about `BUCKET` by their leading bits, with their next
    32 bits. Header: entries, bits (-1: whole keys), number of columns, escapes of each.
    """
    bits = max(0, (len(keys) // BUCKET).bit_length() - 1) if short else -1
    escaped = [np.flatnonzero(c >= ESCAPE) for c in columns]
    arrays = [np.array([len(keys), bits, len(columns), *map(len, escaped)], dtype="<i8")]
    if short:
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
        arrays.append(np.append(np.searchsorted(keys, edges), len(keys)).astype("<u4"))
        arrays.append(((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4"))
    else:
        arrays.append(keys.astype("<u8"))
    for column, at in zip(columns, escaped):
        arrays += [at.astype("<u4"), column[at].astype("<i8"), np.minimum(column, ESCAPE).astype(np.uint8)]
    return arrays


class Packed:
    """A file of sorted keys with counts: mapped where the folder is a mounted path, else read."""

    def __init__(self, folder: str, name: str):
        system, path = open_folder(folder)
        if system.type_name == "local":
            self.raw = np.memmap(f"{path}/{name}", dtype=np.uint8, mode="r")
        else:
            with system.open_input_file(f"{path}/{name}") as file:
                self.raw = np.frombuffer(file.read(), dtype=np.uint8)
        self.at = 0
        self.n, self.bits, width = self._next("<i8", 3).tolist()
        escapes = self._next("<i8", width).tolist()
        if self.bits >= 0:
            self.edges = self._next("<u4", (1 << self.bits) + 1)
        self.keys = self._next("<u4" if self.bits >= 0 else "<u8", self.n)
        self.columns = [(self._next("<u4", k), self._next("<i8", k), self._next("u1", self.n)) for k in escapes]

    def _next(self, kind: str, n: int) -> np.ndarray:
        """The next n numbers; they need not lie on a multiple of their size."""
        size = n * np.dtype(kind).itemsize
        self.at += size
        return np.frombuffer(self.raw, kind, n, self.at - size) if n else np.zeros(0, kind)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each wanted key is, whether it is there)."""
        if not self.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        if self.bits < 0:
            at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
            return at, self.keys[at] == wanted
        bucket = (wanted >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(wanted), np.int64)
        rest = ((wanted << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
        low, end = (self.edges[bucket + k].astype(np.int64) for k in (0, 1))
        high = end.copy()
        for _ in range(int((end - low).max(initial=0)).bit_length()):
            middle = np.minimum((low + high) // 2, self.n - 1)
            less = (low < high) & (self.keys[middle] < rest)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(middle, high))
        at = np.minimum(low, self.n - 1)
        return at, (low < end) & (self.keys[at] == rest)

    def column(self, k: int, at: np.ndarray) -> np.ndarray:
        places, values, short = self.columns[k]
        out = short[at].astype(np.int64)
        big = np.flatnonzero(out == ESCAPE)
        out[big] = values[np.searchsorted(places, at[big])]
        return out


def _read(model: dict, files: dict, keys: np.ndarray, out: np.ndarray) -> None:
    """Fill the rows of `out` with the counts at each key; zeros if unknown."""
    shard = _shard(keys, model["shards"])
    order = np.lexsort((keys, shard))
    numbers, first = np.unique(shard[order], return_index=True)
    bounds = np.append(first, len(order)).tolist()
    local = "://" not in model["folder"] or model["folder"].startswith("file:")
    for number, a, b in zip(numbers.tolist(), bounds[:-1], bounds[1:]):
        if number not in files:
            continue
        mine = order[a:b]
        where = (model["folder"], files[number])
        file = once(("ngrams", *where), lambda: Packed(*where)) if local else Packed(*where)  # noqa: B023
        at, there = file.find(keys[mine])
        for k in range(len(file.columns)):
            out[k, mine[there]] = file.column(k, at[there])


def _lookup(model: dict, n: int, context: np.ndarray | None, last: np.ndarray):
    """For distinct n-grams: count, and of the context total, N1, N2, N3+; zeros if unknown."""
    out = np.zeros((5 if n > 1 else 2, len(last)))
    _read(model, model["files"][n], _gram_hash(context, last), out)
    if n > 1:
        _read(model, model["contexts"][n], context, out[1:])
    return out


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    off = np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]
    return counts - off


def token_scores(model: dict, sequence: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability, raw count) of each token."""
    last, back = np.unique(sequence[at], return_inverse=True)
    found = _lookup(model, 1, None, last)
    total = max(model["total"], 1)
    rest = sum(d * k for d, k in zip(model["discounts"][1], model["often"])) / total if model["total"] else 1.0
    p = (_discounted(found[0], model["discounts"][1]) / total + rest / (model["vocabulary"] + 1))[back]
    raw = found[1][back]
    for n in range(2, model["order"] + 1):
        context = _context_hash([sequence[at - k] for k in range(n - 1, 0, -1)])
        keys = _gram_hash(context, sequence[at])
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        found = _lookup(model, n, context[first], sequence[at][first])
        d = model["discounts"][n]
        seen = found[1] > 0
        mass = np.maximum(found[1], 1)
        own = np.where(seen, _discounted(found[0], d) / mass, 0.0)
        rest = np.where(seen, (d[0] * found[2] + d[1] * found[3] + d[2] * found[4]) / mass, 1.0)
        p = own[back] + rest[back] * p
    return np.log10(p), raw


RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(model: dict):
    def run(batches):
        tokens, kinds = model["tokens"], model["vocabulary"]
        for batch in slices(batches, limit=SCORE_BYTES):
            sequence, at, lengths = _sequence(batch.column("text"), model["order"])
            logs, raw = token_scores(model, sequence, at)
            base = np.log10((raw + 1) / (tokens + kinds + 1))
            first = np.cumsum(lengths) - lengths
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), pa.array(lengths.astype(np.int64)),
                    pa.array(add((raw > 0).astype(np.int64))), pa.array(np.full(len(lengths), tokens, np.int64)),
                    pa.array(add(base)), pa.array(add(logs)),
                ],
                names=[part.split(" ")[0] for part in RESULT.split(", ")],
            )

    return run


def score(rows: DataFrame, model: dict) -> DataFrame:
    """Score doc_id, held_out, text."""
    return rows.mapInArrow(_score(model), RESULT)


def train_and_score(docs: DataFrame, order: int = ORDER, **options) -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    modulus, remainder = HELD_OUT
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(digest == remainder, F.lit(False)).alias("held_out"),
        text_of().alias("text"),
    )
    return score(rows, train(rows.where("not held_out"), order, **options))
