"""Operator 8, near-duplicate groups by HyperMinHash.

A document is the set of its distinct word shingles. Documents with equal sets are one class.
A sketch has 256 registers, each the least hash of a bucket compressed to 16 bits: its leading
zeros and the 10 bits after the first one. So that no bucket stays empty, a set of 2^c to
2^(c+1) shingles has 2^(c-3) buckets under each of several hash seeds; a set within a fifth of
the next size class has a sketch of that class as well, so that any two sets that may be linked
share one. Bands of 6 registers deal the classes to band buckets.

In a band bucket one member, drawn by a hash, leads, and the others are paired with it only.
Pairs are judged by their registers (equal ones, corrected for expected chance collisions, with
a margin of five deviations). Members that are far from their leader choose a new one, for
`LEADERS` rounds. A member may be near its leader and also near one that the leader is far from;
so each bucket that then holds more than one family (what hangs together by near pairs) is
compared in full by registers, all members outside of its largest family with all its members,
in blocks that give out a spanning forest of the near pairs. Near pairs are then confirmed on the full sets, the best of each class first; ends that then hang
together need no proof. Families that are not yet one component are at last compared in blocks: every member outside of the largest component with
all members, on full sets, giving out links only. So no group gives out its pairs, and none
meets in one task.

A pair at similarity 0.8 misses all 42 bands with a probability of 3e-6, and less above it.
Components are found by contraction inside of tasks, then by alternating large and small stars,
stored after each round.

Defined results: words are runs outside of space and U+0009 to U+000D, A-Z folded; a document
with fewer words than a shingle has their sequence as its only one; a null or empty text has
no shingle, is linked with nothing and is its own component; component_id is the least doc_id
in reach; rows equal in id and text get equal rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import one_of_each, small_side, stored, text_of
from tabloom.llm.words import Texts, hashes, scramble, slices, window_hashes
from tabloom.session import discard

SHINGLE = 5
THRESHOLD = 80  # percent
REGISTERS, MANTISSA = 256, 10
BAND, BANDS = 6, 42
EMPTY = 0xFFFF
DEVIATIONS = 5
LEADERS = 3
BLOCK = 128
UNIT = 4_096
COLUMNS = 20_000
LINKS = 100_000

FEATURES = "doc_id long, digest long, n_shingles long, members binary, sketches array<struct<size:int,registers:binary>>"


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = Texts(column, lower=True)
    words = texts.words()
    codes, distinct = words.coded()
    each = hashes(distinct)[codes]
    windows = window_hashes(each, width)
    out = []
    for first, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if stop - first >= width:
            out.append(np.unique(windows[first : stop - width + 1]))
        else:
            out.append(window_hashes(each[first:stop], stop - first) if stop > first else np.zeros(0, np.uint64))
    return out


def registers(members: np.ndarray, size: int, seeds: np.ndarray) -> np.ndarray:
    """The sketch of a set for size class `size`: the compressed least hash of every bucket."""
    buckets = min(max(1, 1 << max(0, size - 3)), REGISTERS)
    rows, bits = REGISTERS // buckets, buckets.bit_length() - 1
    h = members[None, :] * seeds[:rows, None]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    out = np.full((rows, buckets), EMPTY, dtype=np.uint16)
    if bits:
        h.sort(axis=1)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        first = np.ones(bucket.shape, dtype=bool)
        first[:, 1:] = bucket[:, 1:] != bucket[:, :-1]
        row, column = np.nonzero(first)
        place, least = bucket[row, column], h[row, column] << np.uint64(bits)
    else:
        row, place, least = np.arange(rows), np.zeros(rows, np.int64), h.min(axis=1)
    # Below 2**53 a float has the exact length of a number, and its mantissa the bits after it.
    least = least >> np.uint64(11)
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros, low = (53 - exponent).astype(np.int64), ((mantissa * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    out[row, place] = np.where(least > 0, zeros << MANTISSA | low, 54 << MANTISSA)
    return out.ravel()


def sketches(members: np.ndarray, seeds: np.ndarray) -> list[dict]:
    """The sketches of a set: of its size class, and of the next one if linked sets may be in it."""
    n = len(members)
    if not n:
        return []
    size = n.bit_length() - 1
    sizes = [size, size + 1] if 100 * n >= THRESHOLD << (size + 1) else [size]
    return [{"size": c, "registers": registers(members, c, seeds).tobytes()} for c in sizes]


def hash_seeds() -> np.ndarray:
    return scramble(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, registers it rests on) of each pair of rows of registers."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(axis=1)
    equal = ((a == b) & used).sum(axis=1)
    ratio = np.maximum(size_a, size_b) / np.minimum(size_a, size_b)
    # Expected chance collisions of registers of unlike sets, for sets well above the buckets.
    chance = 0.1699194871597391 * 4 * ratio / (1 + ratio) ** 2 * REGISTERS / (1 << MANTISSA)
    return np.clip((equal - chance) / np.maximum(n, 1), 0, 1), n


def _features(width: int):
    def run(batches):
        seeds = hash_seeds()
        kind = pa.list_(pa.struct([("size", pa.int32()), ("registers", pa.binary())]))
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest, pa.binary()), pa.array([sketches(s, seeds) for s in sets], kind),
                ],
                names=["doc_id", "digest", "n_shingles", "members", "sketches"],
            )

    return run


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.withColumn("digest", F.xxhash64("text"))


def classes_of(features: DataFrame) -> DataFrame:
    """A stored row for each distinct set: node (its number), least document, size, sketches."""
    grouped = features.where("n_shingles > 0").groupBy("members").agg(
        F.min(F.struct("doc_id", "digest")).alias("least"), F.min("doc_id").alias("doc_id"),
        F.first("n_shingles").alias("n"), F.first("sketches").alias("sketches"),
    )
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def band_members(classes: DataFrame) -> DataFrame:
    """Stored (key, node, n, size) of the bands that more than one class shares."""
    width = 2 * BAND
    cut = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.struct(i.alias("band"), F.expr("sketch.registers").substr(i * width + 1, F.lit(width)).alias("part")),
    )
    each = classes.select("node", "n", F.explode("sketches").alias("sketch"))
    bands = each.select("node", "n", "sketch.size", F.explode(cut).alias("b")).where(F.col("b.part") != F.lit(b"\xff" * width))
    bands = bands.select("node", "n", "size", F.xxhash64("size", "b.band", "b.part").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key")
    return stored(bands.join(shared.hint("merge"), "key"), "bands")


def _sizes_allow(a, b):
    """Sets whose sizes are further apart than the threshold cannot reach it."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def _led(members: DataFrame, turn: int) -> DataFrame:
    """The members of each key with its leader of this round; a lone member has none."""
    draw = F.xxhash64(F.lit(turn), "key", "node").alias("draw")
    draw = F.struct(draw, F.col("node").alias("leader"), F.col("n").alias("leader_n"))
    leaders = members.groupBy("key").agg(F.min(draw).alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")
    return members.join(leaders.select("key", "first.leader", "first.leader_n"), "key").where("node != leader")


def near_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored (a, b, likely): near pairs that join all that hangs together by registers in a bucket.

    Rounds of leaders join most; then every bucket that still holds several families is compared
    in full, those that left it in a round included.
    """
    found, left = None, members
    for turn in range(LEADERS):
        led = stored(_led(left, turn), "led")
        ends = led.where(_sizes_allow(F.col("n"), F.col("leader_n")))
        ends = ends.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "size")
        near = judged(ends.groupBy("a", "b").agg(F.min("size").alias("size")), classes)
        found = near if found is None else found.union(near)
        both = near.select(F.col("a").alias("node"), F.col("b").alias("leader"))
        both = both.union(near.select(F.col("b"), F.col("a")))
        left = stored(led.join(both, ["node", "leader"], "left_anti").select("key", "node", "n", "size"), "far")
        discard(led)
        if left.isEmpty():
            break
    found = found.union(bucket_links(members, components(found), classes))
    return stored(found.groupBy("a", "b").agg(F.max("likely").alias("likely")), "near")


def bucket_links(members: DataFrame, families: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored (a, b, likely): near pairs across the families of a bucket, a spanning forest a block.

    Every member outside of the bucket's largest family meets all members, by registers and in
    blocks; blocks are dealt to units of about `UNIT` of the dealt rows. Up to LEADERS + 1 members of as many
    families have all met as leaders.
    """
    named = families.select("node", F.col("comp").alias("family"))
    placed = members.join(named, "node", "left").withColumn("family", F.coalesce("family", "node"))
    parts = placed.groupBy("key", "family").agg(F.count(F.lit(1)).alias("n"))
    top = parts.groupBy("key").agg(
        F.max(F.struct("n", "family")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("families")
    )
    met = (F.col("families") == F.col("all")) & (F.col("all") <= LEADERS + 1)
    mixed = top.where((F.col("families") > 1) & ~met)
    mixed = mixed.select("key", F.col("top.family").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("n_odd"))
    rows = stored(placed.join(mixed, "key"), "mixed")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    copies = blocks("n_odd") + F.when(F.col("family") != F.col("main"), blocks("all")).otherwise(0)
    units = max(1, (rows.agg(F.sum(copies.cast("long"))).first()[0] or 0) // UNIT)
    mine = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    whole = ("key", "node", "n", "size", "family")
    every = F.sequence(F.lit(0), blocks("n_odd") - 1)
    members = rows.select(*whole, F.lit(False).alias("odd"), F.explode(every).alias("i"), mine("all").alias("j"))
    every = F.sequence(F.lit(0), blocks("all") - 1)
    odd = rows.where("family != main")
    odd = odd.select(*whole, F.lit(True).alias("odd"), mine("n_odd").alias("i"), F.explode(every).alias("j"))
    each = classes.select("node", F.explode("sketches").alias("s")).select("node", "s.size", "s.registers")
    dealt = members.unionByName(odd).join(each, ["node", "size"])
    dealt = dealt.withColumn("block", F.xxhash64("key", "i", "j"))
    dealt = dealt.select(F.pmod("block", F.lit(units)).alias("unit"), "block", "node", "n", "family", "odd", "registers")
    return stored(dealt.groupBy("unit").applyInArrow(_unit_links, "a long, b long, likely double"), "judged")


def _unit_links(table: pa.Table) -> pa.Table:
    """Of each block of a unit, near pairs of odd members and members that join its families."""
    table = table.combine_chunks()
    block, node, n, family = (table.column(c).to_numpy() for c in ("block", "node", "n", "family"))
    odd = table.column("odd").to_numpy(zero_copy_only=False)
    sketch = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    order = np.lexsort((odd, block))
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    out = ([], [], [])
    for rows in np.split(order, cuts):
        split = int(np.searchsorted(odd[rows], True))
        right, left = rows[:split], rows[split:]
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i in left.tolist():
            fits = (family[right] != family[i]) & (100 * np.minimum(n[right], n[i]) >= THRESHOLD * np.maximum(n[right], n[i]))
            some = right[fits]
            if not len(some):
                continue
            value, used = estimate(sketch[i][None], sketch[some], np.full(len(some), n[i], np.float64), n[some].astype(np.float64))
            near = value + _slack(used) >= THRESHOLD / 100
            for j, likely in zip(some[near].tolist(), value[near].tolist()):
                a, b = find(int(family[i])), find(int(family[j]))
                if a != b:
                    root[a] = b
                    for column, cell in zip(out, (min(node[i], node[j]), max(node[i], node[j]), likely)):
                        column.append(cell)
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table({name: pa.array(column, kind) for name, column, kind in zip(("a", "b", "likely"), out, kinds)})


def _slack(used: np.ndarray) -> np.ndarray:
    """How far below the threshold the estimate of a linked pair may lie."""
    return DEVIATIONS * np.sqrt(THRESHOLD / 100 * (1 - THRESHOLD / 100) / np.maximum(used, 1))


def _judge(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")
        )
        sizes = [batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb")]
        value, n = estimate(a, b, *sizes)
        keep = pa.array(value + _slack(n) >= THRESHOLD / 100)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(value).filter(keep)],
            names=["a", "b", "likely"],
        )


def judged(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored (a, b, likely): of (a, b, size), those that the registers of that size call near."""
    each = classes.select("node", "n", F.explode("sketches").alias("s")).select("node", "n", "s.size", "s.registers")
    left = each.select(F.col("node").alias("a"), "size", F.col("registers").alias("ra"), F.col("n").alias("na"))
    right = each.select(F.col("node").alias("b"), "size", F.col("registers").alias("rb"), F.col("n").alias("nb"))
    rows = pairs.join(left, ["a", "size"]).join(right, ["b", "size"]).select("a", "b", "ra", "rb", "na", "nb")
    return stored(rows.mapInArrow(_judge, "a long, b long, likely double"), "judged")


def _sets(width: int):
    def run(batches):
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"]
            )

    return run


def _confirm(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= THRESHOLD * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])


def full_sets(nodes: DataFrame, classes: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Stored (node, set): the sorted shingle hashes of the given classes, from their texts."""
    wanted = stored(nodes.join(classes, "node").select("node", "least.doc_id", "least.digest"), "wanted")
    same = F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.digest") == F.col("w.digest"))
    texts = rows.alias("r").join(small_side(wanted).alias("w"), same).select("node", "text")
    return stored(texts.mapInArrow(_sets(width), "node long, set binary"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored (a, b): the pairs that reach the threshold on their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    found = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return stored(found.mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two blocks of sorted sets, some columns at a time."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(shared), COLUMNS):
        columns = shared[at : at + COLUMNS]
        tables = []
        for block in (left, right):
            table = np.zeros((len(block), len(columns)), dtype=np.float32)
            for k, members in enumerate(block):
                part = members[np.searchsorted(members, columns[0]) : np.searchsorted(members, columns[-1], side="right")]
                place = np.minimum(np.searchsorted(columns, part), len(columns) - 1)
                table[k, place[columns[place] == part]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the odd members of a block and the members of another one, where apart."""
    sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
    node, comp, odd = (np.array(table.column(c).to_pylist()) for c in ("node", "comp", "odd"))
    left, right = np.flatnonzero(odd), np.flatnonzero(~odd)
    a, b = [], []
    if len(left) and len(right):
        both = _common([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(s) for s in sets], dtype=np.float64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        hit = (100 * both >= THRESHOLD * union) & (comp[left][:, None] != comp[right][None, :])
        i, j = np.nonzero(hit)
        a, b = node[left[i]].tolist(), node[right[j]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def family_links(near: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored (a, b): links between components of a family, found on full sets in blocks.

    Each member outside of the family's largest component is odd. Odd members and all members
    are dealt to blocks, and each block of odd ones meets each block of members once.
    """
    families = components(near).select("node", F.col("comp").alias("family"))
    placed = families.join(comps, "node", "left").select("family", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = placed.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("family").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    mixed = top.where(F.col("top.n") < F.col("all"))
    mixed = mixed.select("family", F.col("top.comp").alias("main"), "all", (F.col("all") - F.col("top.n")).alias("odd"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    rows = placed.join(mixed, "family").withColumn("spread", F.xxhash64("node"))
    mine = lambda n: F.pmod("spread", blocks(n)).cast("int")
    every = F.sequence(F.lit(0), blocks("odd") - 1)
    members = rows.select("family", "node", "comp", F.lit(False).alias("odd"), F.explode(every).alias("i"), mine("all").alias("j"))
    every = F.sequence(F.lit(0), blocks("all") - 1)
    odd = rows.where("comp != main")
    odd = odd.select("family", "node", "comp", F.lit(True).alias("odd"), mine("odd").alias("i"), F.explode(every).alias("j"))
    dealt = members.unionByName(odd).join(sets, "node")
    dealt = dealt.dropDuplicates(["family", "i", "j", "odd", "node"])
    return stored(dealt.groupBy("family", "i", "j").applyInArrow(_block_links, "a long, b long").distinct(), "links")


def least_in_reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) by the links (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        # Each root hangs on the least root next to it; links inside of a component are done with.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, above := root[root]):
            root = above
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def _contract(rows: int):
    """Links as (node, least node in reach by some `rows` links), the least nodes with themselves."""

    def flush(held):
        nodes, least = least_in_reach(*(np.concatenate([batch.column(c).to_numpy() for batch in held]) for c in "ab"))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["a", "b"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= rows:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp), from a stored table: the least node in reach, for every node that has a link.

    Each task first contracts some `LINKS` of its links on its own, so that few rounds are left:
    large stars hang the larger neighbours of a node on its least neighbour, small stars the
    smaller ones, until every edge ends in the least node of its component. Links that one task
    has contracted all need no round.
    """
    tasks = -(-links.count() // LINKS)
    own = links.select("a", "b").coalesce(max(1, tasks)).mapInArrow(_contract(LINKS), "a long, b long")
    own = stored(own, "contracted")
    if tasks <= 1:
        return own.toDF("node", "comp")
    edges = stored(own.where("a != b").distinct(), "edges")
    discard(own)
    while True:
        # Done when no end of an edge begins another one, and no node begins two.
        ends = edges.select("a", F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
        seen = ends.groupBy("a").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if seen.where("ups > 1 or ups = 1 and low = 0").isEmpty():
            break
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after = stored(small.where("a != b").distinct(), "edges")
        discard(edges)
        discard(large)
        edges = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    left = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    right = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    known = pairs.join(left, "a", "left").join(right, "b", "left")
    return known.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b", "likely")


def settle(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored (a, b): links that hold the components together, as far as near pairs show them.

    The best pair of each class is confirmed first, as it joins most groups; the pairs whose
    ends are then still apart are confirmed in full.
    """
    ends = near.select(F.col("a").alias("end"), "a", "b", "likely").union(near.select("b", "a", "b", "likely"))
    best = ends.groupBy("end").agg(F.max(F.struct("likely", "a", "b")).alias("p"))
    best = stored(best.select("p.a", "p.b").distinct(), "best")
    links = confirmed(best, sets)
    rest = _apart(near.join(best, ["a", "b"], "left_anti"), components(links))
    return links.union(confirmed(rest, sets))


def near_groups(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, digest, n_shingles, component_id and comp (null without shingles)."""
    rows = _rows(docs)
    features = stored(rows.mapInArrow(_features(width), FEATURES), "shingles")
    classes = classes_of(features)
    near = near_pairs(band_members(classes), classes)
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    sets = full_sets(nodes, classes, rows, width)
    links = settle(near, sets)
    links = links.union(family_links(near, components(links), sets))
    comps = components(links)

    named = classes.join(comps, "node", "left").select("members", "doc_id", F.coalesce("comp", "node").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(least, "comp").select("members", "component_id", "comp"), "named")
    joined = features.drop("sketches").join(named, "members", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "digest", "n_shingles", component.alias("component_id"), "comp")


def near_dedup(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    return near_groups(docs, width).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The rows of `docs` without the near copies: of each group the least (doc_id, text) stays."""
    groups = stored(near_groups(docs, width).select("doc_id", "digest", "comp"), "groups")
    first = groups.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    marked = groups.join(first, "comp").withColumn("stays", F.struct("doc_id", "digest").eqNullSafe(F.col("first")))
    dropped = stored(marked.where("not stays").select("doc_id", "digest").distinct(), "dropped")
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_digest")
    )
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))
    left = rows.join(small_side(dropped), same, "left_anti")
    # A repeated row is a copy, too; rows without a word are no one's copy.
    slim = marked.where("stays").selectExpr("doc_id as _id", "digest as _digest")
    return one_of_each(left, slim, ["_id", "_digest"]).select("_row.*")
