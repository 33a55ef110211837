"""Exact and near dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabloom.llm import exact_dedup, near_dedup
from tabloom.llm.queries import EXACT_DEDUP_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def test_exact_groups(docs, cases):
    groups = defaultdict(list)
    for i, t, _ in cases:
        groups[t or ""].append(i)
    rows = exact_dedup.copy_groups(docs).collect()
    assert len(rows) == len(cases)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        spare = Counter(ids)
        for i in ids:
            stays = i == keep and spare[i] == Counter(ids)[i]
            spare[i] -= 1
            want[i, keep, len(ids), stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_exact_dedup_rows(docs, cases):
    out = exact_dedup.exact_dedup(docs)
    assert out.columns == docs.columns
    best = {}
    for i, t, _ in cases:
        best[t or ""] = max((x for x in (best.get(t or ""), i) if x is not None), default=None)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted((i or 0, t) for t, i in best.items())


def test_exact_prefix_alone_is_no_copy(spark):
    start = "p" * 300
    rows = [(1, start + "a"), (2, start + "b"), (3, start + "a"), (4, "q" * 301)]
    got = exact_dedup.copy_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)}
    assert "window copies" in EXACT_DEDUP_SQL


def test_rows_without_a_twin_are_spread(spark, monkeypatch):
    """Without a broadcast no partition of the last join holds a large part of the rows."""
    monkeypatch.setattr(exact_dedup, "small_side", lambda df: df.hint("merge"))
    rows = [(i, f"text {i} " + "x" * (i % 40)) for i in range(4000)] + [(9000 + i, "copy") for i in range(50)]
    got = exact_dedup.copy_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        sizes = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sum(sizes) == 4050 and max(sizes) < 2 * 4050 / 8


def shingles(text, width=near_dedup.SHINGLE):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) >= width:
        return frozenset(tuple(words[j : j + width]) for j in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(rows):
    """Least doc_id in reach by row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_near_groups(docs, cases):
    rows = near_dedup.near_dedup(docs).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert got == Counter(components([(i, t) for i, t, _ in cases]))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def mutated(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_groups_of_many_mutations(spark):
    """Chains, stars and pairs just above and below the threshold, long and short."""
    rng, rows = random.Random(3), []
    for length in (9, 14, 30, 80, 300):
        for _ in range(6):
            words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
            for k in range(6):
                rows.append((len(rows), mutated(rng, words, k * length // 60)))
                words = rows[-1][1].split(" ") if k % 2 else words
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame).collect()}
    assert got == {i: c for i, _, c in components(rows)}
    assert len(set(got.values())) < len(rows)


def test_near_copies_dropped(docs, cases):
    out = near_dedup.drop_near_copies(docs)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in out.collect())
    want = [i if i is not None else -1 for i, n, c in components([(i, t) for i, t, _ in cases]) if n == 0 or c in (i, None)]
    assert ids == sorted(want)


def test_registers_and_estimate():
    rng, seeds = np.random.default_rng(5), near_dedup.hash_seeds()
    pool = rng.integers(0, 1 << 64, 9000, dtype=np.uint64)
    for n in (3, 12, 60, 500, 4000):
        a, b = np.unique(pool[:n]), np.unique(pool[n // 10 : n + n // 10])
        size = n.bit_length() - 1
        ra, rb = near_dedup.registers(a, size, seeds)[None], near_dedup.registers(b, size, seeds)[None]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        value, used = near_dedup.estimate(ra, rb, np.array([n]), np.array([n]))
        assert used[0] >= 250 and abs(value[0] - true) < 0.13
        apart = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert near_dedup.estimate(ra, near_dedup.registers(apart, size, seeds)[None], np.array([n]), np.array([n]))[0][0] < 0.05
    # One bucket and seed 1: leading zeros, then the 10 bits after the first one.
    least = min(int(h) for h in _hashed(pool[:5], seeds[0]))
    zeros = 64 - least.bit_length()
    want = zeros << 10 | (least << zeros & (1 << 63) - 1) >> 53
    assert near_dedup.registers(np.unique(pool[:5]), 2, seeds)[0] == want


def _hashed(members, seed):
    h = members * seed
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def test_sketch_sizes():
    seeds = near_dedup.hash_seeds()
    sizes = lambda n: [s["size"] for s in near_dedup.sketches(np.arange(n, dtype=np.uint64), seeds)]
    assert sizes(0) == [] and sizes(1) == [0] and sizes(12) == [3] and sizes(13) == [3, 4] and sizes(16) == [4]
    # Sets that may be linked share a size class.
    assert all(set(sizes(a)) & set(sizes(b)) for a in range(1, 140) for b in range(a, 5 * a // 4 + 1))


def test_common_counts():
    rng = np.random.default_rng(2)
    blocks = [[np.unique(rng.integers(0, 400, rng.integers(1, 90), dtype=np.uint64)) for _ in range(n)] for n in (7, 9)]
    want = [[len(np.intersect1d(a, b)) for b in blocks[1]] for a in blocks[0]]
    assert near_dedup._common(*blocks).tolist() == want


def test_large_family_in_blocks(spark, monkeypatch):
    """A family of several blocks, with members that hang on by one link only."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, base = random.Random(11), [f"b{k}" for k in range(90)]
    rows = [(i, mutated(rng, base, rng.randrange(0, 6))) for i in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame).collect()}
    assert got == {i: c for i, _, c in components(rows)}


def test_near_copy_of_a_template(spark):
    """M is near most pages by registers, its copy X near none of them: the two still meet."""
    rng, rows, want = random.Random(17), [], {}
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(1003)]
        own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
        texts = [base, base[:895] + own(108)]  # 892 of 1,108 shingles are shared: 0.805
        for _ in range(400):
            at = rng.randrange(600)
            texts.append(base[:at] + own(177) + base[at + 177 :])
        first = len(rows)
        rows += [(first + k, " ".join(t)) for k, t in enumerate(texts)]
        # By brute force: a matrix of the members' shared shingles.
        sets = [shingles(t, 4) for _, t in rows[first:]]
        place = {s: k for k, s in enumerate(sorted(sets[0]))}
        table = np.zeros((len(sets), len(place)), dtype=np.float32)
        for k, members in enumerate(sets):
            table[k, [place[s] for s in members if s in place]] = 1
        both, sizes = table @ table.T, np.array([len(s) for s in sets])
        linked = 100 * both >= 80 * (sizes[:, None] + sizes[None, :] - both)
        assert np.argwhere(np.triu(linked, 1)).tolist() == [[0, 1]]
        want |= {first + k: first + (0 if k == 1 else k) for k in range(len(texts))}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(frame, 4).collect()}
    assert got == want


def test_units_of_a_large_bucket(spark, monkeypatch):
    """One bucket of 3,000 unlike members: no unit holds above twice `UNIT` of the dealt rows."""
    rng = np.random.default_rng(3)
    rows = [(k, 100, [(6, rng.integers(0, 50_000, 256).astype(np.uint16).tobytes())]) for k in range(3_000)]
    classes = near_dedup.stored(spark.createDataFrame(rows, "node long, n long, sketches array<struct<size:int,registers:binary>>"), "classes")
    members = classes.selectExpr("7L as key", "node", "n", "6 as size")
    families = spark.createDataFrame([], "node long, comp long")

    def counted(table):
        import pyarrow as pa

        return pa.table({"a": [table.num_rows], "b": [table.num_rows], "likely": [1.0]})

    monkeypatch.setattr(near_dedup, "_unit_links", counted)
    held = [r["a"] for r in near_dedup.bucket_links(members, families, classes).collect()]
    copies = (3_000 + 2_999) * (3_000 // near_dedup.BLOCK + 1)  # the largest family's one member is not odd
    assert sum(held) == copies and max(held) <= 2 * near_dedup.UNIT, (max(held), len(held))


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (10, 11)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], []])
def test_components(spark, edges):
    got = {r["node"]: r["comp"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("held", [3, 100])
def test_components_contracted_in_tasks(spark, monkeypatch, held):
    """Links of one task need no round of stars; those of many tasks still come together."""
    rng, labels, n = random.Random(held), [], 300
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(200)]
    edges = [(a, b) for a, b in edges if a != b] + [(k, k + 1) for k in range(1_000, 1_040)] + [(7, 7_000)] * 3
    rng.shuffle(edges)
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    store = near_dedup.stored
    monkeypatch.setattr(near_dedup, "stored", lambda df, label: labels.append(label) or store(df, label))
    links = store(spark.createDataFrame(edges, "a long, b long").repartition(6), "links")
    monkeypatch.setattr(near_dedup, "LINKS", held * len(edges) // 100)
    rows = near_dedup.components(links).collect()
    assert Counter((r["node"], r["comp"]) for r in rows) == Counter(root.items())
    assert (len(labels) == 1) == (held == 100), labels


def test_empty_tables(nothing):
    assert exact_dedup.copy_groups(nothing).count() == 0 and exact_dedup.exact_dedup(nothing).count() == 0
    assert near_dedup.near_dedup(nothing).count() == 0 and near_dedup.drop_near_copies(nothing).count() == 0
