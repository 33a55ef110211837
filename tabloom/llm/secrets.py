"""Operator 3, secret scans through a trigram inverted index.

Every rule is a regular expression. `trigram_query` derives from its parse tree alternatives of
mandatory trigrams (an OR of ANDs, over bytes with A-Z folded). `build_index` writes postings,
trigram -> keys of the texts that contain it, for the trigrams that the rules mention.
`candidates` intersects the postings of each alternative: the bits of the trigrams are OR-ed
by key, combined on the map side, and compared with the alternative's mask. Only candidates
are verified with the expression itself, on the whole text; a rule without mandatory trigrams
is run on every text.

Defined results: a null text counts as empty and has no spans; rows equal in id and text get
equal results; keys are 64-bit digests, a clash only adds a candidate that verification drops.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import small_side, stored, text_of
from tabloom.llm.words import Texts, lists, slices

MAX_STRINGS = 64
BITS = 62

FOLD = re.IGNORECASE | re.ASCII
#: kind: expression, flags, measured group, least length of that group. The first three are the
#: base; the others are published token formats.
RULES = {
    "assign": (
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", FOLD, 2, 12,
    ),
    "access": (r"AKIA[A-Z0-9]+", re.ASCII, 0, 18),
    "hex": (r"[0-9a-f]{16,}", re.ASCII, 0, 16),
    "pem": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", re.ASCII, 0, 0),
    "forge": (r"gh[pousr]_[A-Za-z0-9]{36,}", re.ASCII, 0, 0),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", re.ASCII, 0, 0),
    "maps": (r"AIza[A-Za-z0-9_-]{35}", re.ASCII, 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", re.ASCII, 0, 0),
}
BASE = ("assign", "access", "hex")


def _strings(node) -> set[str] | None:
    """All strings that a node can match, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                found.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_STRINGS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        whole = set().union(*[p for p in parts if p is not None])
        return None if None in parts or len(whole) > MAX_STRINGS else whole
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 8:
        inner, found = _sequence_strings(arg[2]), set()
        if inner is None:
            return None
        grown = {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                found |= grown
            grown = {a + b for a in grown for b in inner}
            if len(grown) > MAX_STRINGS:
                return None
        return found if len(found) <= MAX_STRINGS else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    whole = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(whole) * len(part) > MAX_STRINGS:
            return None
        whole = {a + b for a in whole for b in part}
    return whole


def _of_strings(strings: set[str]) -> set[frozenset] | None:
    """The alternatives that a choice of strings demands; None if one of them is too short."""
    out = set()
    for s in strings:
        raw = s.encode()
        if len(raw) < 3:
            return None
        out.add(frozenset(int.from_bytes(raw[i : i + 3], "big") for i in range(len(raw) - 2)))
    return out


def _both(a: set[frozenset] | None, b: set[frozenset] | None) -> set[frozenset] | None:
    """Alternatives that meet both demands; the sharper demand alone if they are too many."""
    if a is None or b is None:
        return a if b is None else b
    if len(a) * len(b) > MAX_STRINGS:
        return min(a, b, key=len)
    return {x | y for x in a for y in b}


def _query(nodes) -> set[frozenset] | None:
    demand, literal = None, {""}
    for node in nodes:
        part = _strings(node)
        if part is not None and len(literal) * len(part) <= MAX_STRINGS:
            literal = {a + b for a in literal for b in part}
            continue
        demand = _both(demand, _of_strings(literal))
        literal = part if part is not None else {""}
        if part is None:
            op, arg = node
            inner = None
            if op is sre.SUBPATTERN:
                inner = _query(arg[-1])
            elif op is sre.BRANCH:
                options = [_query(p) for p in arg[1]]
                inner = None if None in options else set().union(*options)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                inner = _query(arg[2])
            demand = _both(demand, inner)
    return _both(demand, _of_strings(literal))


def trigram_query(expression: str, flags: int = 0) -> set[frozenset] | None:
    """Alternatives of trigrams (24-bit numbers of folded bytes), or None: scan everything.

    Any text that the expression matches has all trigrams of at least one alternative.
    """
    found = _query(parser.parse(expression, flags))
    # An alternative that demands more than another one adds nothing.
    return found and {a for a in found if not any(b < a for b in found)}


def _postings(wanted: np.ndarray):
    def run(batches):
        slot = np.zeros(1 << 24, dtype=np.uint16)
        slot[wanted] = np.arange(1, len(wanted) + 1)
        for batch in slices(batches):
            texts = Texts(batch.column("text"), lower=True)
            data = texts.data.astype(np.uint32)
            codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
            found = slot[codes]
            at = np.flatnonzero(found)
            owner = np.searchsorted(texts.offsets, at, side="right") - 1
            pairs = np.unique((found[at].astype(np.int64) - 1) * texts.n + owner)
            keys = batch.column("key").to_numpy(zero_copy_only=False)[pairs % texts.n]
            trigrams, counts = np.unique(pairs // texts.n, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wanted[trigrams].astype(np.int32)), lists(counts, pa.array(keys))], names=["trigram", "keys"]
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def build_index(keyed: DataFrame, trigrams: list[int]) -> DataFrame:
    """Stored postings (trigram, keys) of the given trigrams, a row for each slice of texts."""
    wanted = np.array(sorted(trigrams), dtype=np.int64)
    return stored(keyed.select("key", "text").mapInArrow(_postings(wanted), "trigram int, keys array<long>"), "postings")


def candidates(index: DataFrame, queries: dict[str, set[frozenset]]) -> DataFrame:
    """Stored (key, rules): the texts that may match each rule that has mandatory trigrams."""
    order = sorted({t for alternatives in queries.values() for alt in alternatives for t in alt})
    place = {t: divmod(i, BITS) for i, t in enumerate(order)}
    masks = range(-(-len(order) // BITS))
    spread = index.where(F.col("trigram").isin(order)).select("trigram", F.explode("keys").alias("key"))
    bits = []
    for m in masks:
        value = F.lit(0).cast("long")
        for t, (word, bit) in place.items():
            if word == m:
                value = F.when(F.col("trigram") == t, F.lit(1 << bit).cast("long")).otherwise(value)
        bits.append(F.bit_or(value).alias(f"m{m}"))
    by_key = spread.groupBy("key").agg(*bits)

    def holds(alternative):
        test = F.lit(True)
        for m in masks:
            need = sum(1 << bit for t in alternative for word, bit in [place[t]] if word == m)
            if need:
                test = test & (F.col(f"m{m}").bitwiseAND(F.lit(need)) == F.lit(need))
        return test

    rules = []
    for name, alternatives in queries.items():
        any_of = F.lit(False)
        for alternative in sorted(alternatives, key=sorted):
            any_of = any_of | holds(alternative)
        rules.append(F.when(any_of, F.lit(name)))
    found = by_key.select("key", F.array_compact(F.array(*rules)).alias("rules")).where(F.size("rules") > 0)
    return stored(found, "candidates")


def _verify(rules: dict, everywhere: set[str]):
    def run(batches):
        compiled = {k: (re.compile(e, flags), group, least) for k, (e, flags, group, least) in rules.items()}
        rank = {k: i for i, k in enumerate(rules)}
        for batch in batches:
            out = []
            for doc_id, text, named in zip(
                batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("rules").to_pylist()
            ):
                spans = []
                for kind in everywhere.union(named or ()):
                    expression, group, least = compiled[kind]
                    for m in expression.finditer(text):
                        if m.end(group) - m.start(group) >= least:
                            spans.append((m.start(), rank[kind], m.end(), kind))
                spans.sort()
                count = lambda kind: sum(s[3] == kind for s in spans)  # noqa: E731, B023
                say = lambda some: ",".join(f"{k}:{a}:{b}" for a, _, b, k in some)
                digest = hashlib.sha256(say([s for s in spans if s[3] in BASE]).encode()).hexdigest()
                out.append((doc_id, count("assign"), count("access"), count("hex"), digest, say(spans)))
            columns = [list(c) for c in zip(*out)] or [[] for _ in range(6)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def secret_scan(docs: DataFrame, rules: dict | None = None) -> DataFrame:
    """A row per document with the spans (kind:start:end, code points) of all rules."""
    rules = rules or RULES
    derived = {kind: trigram_query(e, flags) for kind, (e, flags, _, _) in rules.items()}
    indexed = {kind: q for kind, q in derived.items() if q is not None}
    keyed = _keyed(docs)
    index = build_index(keyed, sorted({t for q in indexed.values() for alt in q for t in alt}))
    found = small_side(candidates(index, indexed))
    everywhere = {kind for kind, q in derived.items() if q is None}
    rows = keyed.join(found, "key", "left").select(F.col("doc_id").cast("long"), "text", "rules")
    return rows.mapInArrow(_verify(rules, everywhere), RESULT)
