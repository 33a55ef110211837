"""Mixing and sharding: targets, bounds, laws, reruns."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Weights 5, 2, 1 by source name, null last; capped at 3 times the size, the excess reshared."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in names}
        capped |= over


@pytest.fixture(scope="module")
def many(spark):
    rows = []
    for i in range(600):
        source = None if i % 41 == 0 else "hot" if i % 3 else f"s{i % 7}"
        rows.append((i, " ".join(f"w{k}" for k in range((i * 37) % 90)), source))
    rows.append((600, " ".join(f"long{k}" for k in range(5000)), "s1"))
    rows += [(601, "tiny text", "zz"), (602, None, "empty"), (603, "", "empty")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("clash"))


def test_mix(many):
    rows, frame = many
    got = {r["doc_id"]: r for r in mixing.mix(frame, block_words=16).collect()}
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        assert got[i]["size"] == n and got[i]["taken"] <= 3 * n
        sizes[s] += n
        taken[s] += got[i]["taken"]
    want = targets(sizes)
    for i, _, s in rows:
        assert got[i]["source_size"] == sizes[s] and abs(got[i]["target"] - want[s]) < 1e-6 * max(1, want[s])
    assert all(abs(taken[s] - want[s]) <= 16 for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame.repartition(7), block_words=16).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_mixed_documents(many):
    rows, frame = many
    counts = {r["doc_id"]: r["taken"] for r in mixing.mix(frame, block_words=16).collect()}
    out = mixing.mixed_documents(frame.withColumn("n_chars", F.length("text")), block_words=16)
    texts = {i: t for i, t, _ in rows}
    got = Counter()
    for r in out.collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert r["n_chars"] == len(r["text"]) and r["taken"] == "clash"
        whole = WORD.findall(texts[r["doc_id"]])
        assert words == whole or set(words) <= set(whole) and len(words) < len(whole)
    assert got == {i: n for i, n in counts.items() if n}


def test_mixed_rows_are_contiguous(spark):
    """A pass that takes blocks which are not adjacent gives a row for each stretch of them."""
    long = [f"w{k}" for k in range(400)]
    frame = spark.createDataFrame([(1, " ".join(long), "a"), (2, " ".join(long), "b")], "doc_id long, text string, source string")
    rows = mixing.mixed_documents(frame, block_words=16).collect()
    cut = [r["text"].split() for r in rows if len(r["text"].split()) < len(long)]
    assert len(cut) > 2
    for words in cut:
        at = int(words[0][1:])
        assert words == long[at : at + len(words)]


def test_permutations_are_whole(spark):
    sources = spark.createDataFrame([(0, 1000, 2500), (1, 1, 3), (2, 33_554_393 % 4099, 70), (3, 7, 0)], "src int, blocks long, slots long")
    slots = mixing.draw_slots(sources, shard_slots=100).collect()
    found = defaultdict(list)
    for s in slots:
        found[s["src"], s["pass"]].append(s["block"])
    assert sorted(found[0, 0]) == sorted(found[0, 1]) == list(range(1000)) and found[0, 0] != found[0, 1]
    assert len(found[0, 2]) == len(set(found[0, 2])) == 500 and found[1, 2] == [0] and len(set(found[2, 0])) == 70
    places = defaultdict(set)
    for s in slots:
        places[s["shard"]].add(s["slot"])
    assert len(slots) == 2573 and len(places) == 26
    assert all(places[s] == set(range(100 if s < 25 else 73)) for s in places)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 1023, 1024, 1025, 5000])
def test_feistel_permutation(spark, n):
    frame = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p"), "id")
    got = [r["p"] for r in frame.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:  # neighbours do not keep a constant distance
        steps = Counter((b - a) % n for a, b in zip(got, got[1:]))
        assert steps.most_common(1)[0][1] < 12


def test_counts_of_shards_decide_the_slots(spark):
    """Each shard's counts are a draw given the totals, and its slots are the runs that they name."""
    sources = spark.createDataFrame([(0, 700, 2000), (1, 900, 900), (2, 40, 100)], "src int, blocks long, slots long")
    slots = mixing.draw_slots(sources, shard_slots=100).collect()
    counts, runs = Counter((s["shard"], s["src"]) for s in slots), defaultdict(list)
    for s in sorted(slots, key=lambda s: s["slot"]):
        runs[s["src"], s["shard"]].append(s["k"])
    taken = defaultdict(list)
    for (src, shard), ks in runs.items():
        assert ks == list(range(ks[0], ks[0] + counts[shard, src]))
        taken[src] += ks
    assert {src: sorted(ks) for src, ks in taken.items()} == {0: list(range(2000)), 1: list(range(900)), 2: list(range(100))}
    for src, share in ((0, 2 / 3), (1, 0.3), (2, 1 / 30)):
        found = [counts[shard, src] for shard in range(30)]
        spread = 100 * share * (1 - share) * 2900 / 2999
        assert len(set(found)) > 3 and 0.35 * spread < sum((c - 100 * share) ** 2 for c in found) / 29 < 2.2 * spread


def test_taken_by_brute_force(many):
    """Words taken, from the layout and the slots alone."""
    _, frame = many
    laid, sources = mixing.lay_out(frame, 16, 3)
    times = Counter((s["src"], s["block"]) for s in mixing.draw_slots(sources).collect())
    want = {}
    for d in laid.collect():
        want[d["doc_id"]] = sum(times[d["src"], w // 16] for w in range(d["start"], d["start"] + d["size"]))
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(frame, block_words=16).collect()} == want


def test_mixed_blocks(many):
    rows, frame = many
    got = mixing.mixed_blocks(frame, block_words=16, shard_slots=64).collect()
    laid, sources = mixing.lay_out(frame, 16, 3)
    texts, streams = {i: WORD.findall(t or "") for i, t, _ in rows}, defaultdict(list)
    for d in sorted(laid.collect(), key=lambda d: d["start"]):
        streams[d["src"]] += texts[d["doc_id"]]
    names = {r["src"]: r["source"] for r in sources.collect()}
    slots = mixing.draw_slots(sources, 64).collect()
    want = {(s["shard"], s["slot"]): (names[s["src"]], streams[s["src"]][16 * s["block"] : 16 * s["block"] + 16]) for s in slots}
    assert {(r["shard"], r["slot"]): (r["source"], r["words"]) for r in got} == want and len(got) == len(slots)


def test_repeated_rows_are_mixed_once_each(spark):
    rows = [(1, "a b c d", "x")] * 3 + [(2, "e f g h", "y"), (3, "i j", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = Counter()
    for r in mixing.mix(frame, block_words=2).collect():
        counts[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(frame, block_words=2).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == {i: n for i, n in counts.items() if n}


def check_law(rows, texts, tolerance):
    by_shard = defaultdict(list)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by_shard[r["shard"]].append(r)
    assert set(by_shard) <= set(range(8))
    for some in by_shard.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    loads = [sum(r["size"] for r in by_shard[s]) for s in range(8)]
    assert max(loads) - min(loads) <= tolerance, loads
    return by_shard


def test_sharding(spark):
    rows = [(i, "x" * ((i * 131) % 900)) for i in range(1500)]
    rows += [(2000 + 10 * g + k, f"group {g} " + "y" * (g % 50 * 7)) for g in range(60) for k in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("shard", F.lit("clash"))
    got = sharding.shard_documents(frame).collect()
    check_law(got, dict(rows), 600)
    at = defaultdict(set)
    for r in got:
        if r["doc_id"] >= 2000:
            at[(r["doc_id"] - 2000) // 10].add(r["shard"])
    assert sum(len(s) > 1 for s in at.values()) <= 3  # links are hardly cut
    again = sharding.shard_documents(frame.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_sharding_splits_a_group_larger_than_a_shard(spark):
    rows = [(i, "copy " * 40) for i in range(400)] + [(1000 + i, f"own {i} " * 20) for i in range(500)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_law(got, dict(rows), 500)


def test_sharding_edge_rows(docs, cases):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(cases)
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in cases)
    for s in range(8):
        mine = [r["slot"] for r in rows if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))


def test_edge_rows_mix(docs, cases):
    rows = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in cases)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_empty_tables(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_blocks(nothing).count() == 0
    assert sharding.shard_documents(nothing).count() == 0


def test_a_very_long_document_is_cut_once(spark):
    """300,000 words in blocks of 256: every stretch is right, in linear time."""
    n = 300_000
    rows = [(1, " ".join(f"w{i}" for i in range(n)), "a"), (2, " ".join(f"v{i}" for i in range(n // 2)), "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(frame).collect()}
    out = mixing.mixed_documents(frame).collect()
    words = {i: 0 for i, _, _ in rows}
    for r in out:
        found = r["text"].split()
        at = int(found[0][1:])
        assert found == [f"{found[0][0]}{at + k}" for k in range(len(found))]
        words[r["doc_id"]] += len(found)
    assert words == taken and len(out) > 100
