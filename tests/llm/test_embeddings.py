"""Whitening, hard negatives and near vectors against numpy and plain Python."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import embedding_dedup, hard_negatives, whitening
from tabloom.llm.queries import HARD_NEGATIVES_SQL, NEAR_VECTORS_SQL, QUERIES, mining_rows
from tools.compare import compare

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, weight string, x string, n_links long, anchor string"
WIDTH = 8


def some_rows(seed=3, n=240):
    """Clusters, exact and scaled copies, repeated rows, ties, and everything that is no vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, WIDTH))
    rows = []
    for i in range(n):
        near = centres[i % 6] + rng.normal(size=WIDTH) * (0.05 if i % 3 else 1.0)
        rows.append((i, [float(v) for v in near], i % 4))
    for i in range(20):
        rows.append((1000 + i, [float(v) for v in centres[0]], 1))
    rows += [(1100 + i, [float(v * 2**i) for v in centres[1]], 2) for i in range(8)]
    rows += [(1200, rows[0][1], 0), (1200, rows[0][1], 0), (1300, None, 1), (1301, [], 1), (1302, [0.0] * WIDTH, 1)]
    rows += [(1303, [1.0, None] + [0.0] * (WIDTH - 2), 2), (1304, [math.nan] + [1.0] * (WIDTH - 1), 2)]
    rows += [(1305, [math.inf] + [1.0] * (WIDTH - 1), 2), (1306, [1.0, 2.0], 1), (1400, rows[1][1], None), (None, rows[2][1], 1)]
    rows += [(1500, [3e38] * WIDTH, 3), (1501, [1e-40] * WIDTH, 3)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "r", "w", "x", 7, "a") for i, v, l in rows], SCHEMA).repartition(3)


def good(vector, width=WIDTH):
    return vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector)


def near_by_force(rows, threshold):
    points = [np.array(v, dtype=np.float32).astype(float) if good(v) else np.zeros(WIDTH) for _, v, _ in rows]
    units = np.array([p / np.abs(p).max() if p.any() else p for p in points])
    lengths = np.linalg.norm(units, axis=1)
    units = np.divide(units, lengths[:, None], where=lengths[:, None] > 0, out=np.zeros_like(units))
    linked = units @ units.T >= threshold
    np.fill_diagonal(linked, False)
    out, seen = [None] * len(rows), set()
    for start in range(len(rows)):
        if start in seen:
            continue
        group, todo = {start}, [start]
        while todo:
            for other in np.flatnonzero(linked[todo.pop()]):
                if other not in group:
                    group.add(int(other))
                    todo.append(int(other))
        seen |= group
        least = min((rows[i][0] for i in group if rows[i][0] is not None), default=None)
        for i in group:
            out[i] = (rows[i][0], int(linked[i].sum()), least, rows[i][0] is not None and rows[i][0] == least)
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 4, "block_dims": 3}, {"cell_rows": 16, "block_dims": 8, "sample_rows": 20}])
def test_near_vectors(spark, options):
    rows = some_rows()
    got = embedding_dedup.near_vectors(table(spark, rows), threshold=0.95, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == near_by_force(rows, 0.95)


def test_near_vectors_at_a_low_threshold(spark):
    rows = some_rows(5, 150)
    got = embedding_dedup.near_vectors(table(spark, rows), threshold=0.6, cell_rows=8, block_dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == near_by_force(rows, 0.6)


def test_a_large_group_gives_rows_in_proportion(spark):
    """Near copies of one vector in many chunks: all links counted, no row for a pair."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=WIDTH)
    rows = [(i, [float(v) for v in centre + rng.normal(size=WIDTH) * 0.01], 0) for i in range(900)]
    df = table(spark, rows).select("vec_id", "embedding")
    reps = df.select(F.xxhash64("embedding").alias("h1"), F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("vec"))
    found = embedding_dedup._linked(reps, WIDTH, 0.95, 4, 100, 500)
    assert found.count() < 900 * 2 * 12 * 3  # vectors x blocks x chunks x kinds, and not 900 x 899
    got = embedding_dedup.near_vectors(df, cell_rows=100, block_dims=4).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(899, 0)}


def test_near_vectors_of_nothing(spark):
    assert embedding_dedup.near_vectors(table(spark, [])).collect() == []
    lone = embedding_dedup.near_vectors(table(spark, [(4, None, 1), (None, None, 1)])).collect()
    assert sorted(map(tuple, lone), key=repr) == [(4, 0, 4, True), (None, 0, None, False)]


def negatives_by_force(rows, positives=5, negatives=10, lowest=30, highest=90):
    out = []
    for anchor, label, vector in rows:
        if anchor % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, l) for i, l, v in rows if i != anchor)
        for down, i, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(d, j) for d, j, l in scored if l != label and lowest * -down <= 100 * -d <= highest * -down]
            out += [(anchor, i, rank, j, -down, -d) for rank, (d, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def whole_rows(n=330, seed=1, spread=40, width=5):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(4)), [int(v) for v in rng.integers(-spread, spread + 1, width)]) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"anchor_rows": 2, "segment_rows": 50}])
@pytest.mark.parametrize("spread", [40, 1])
def test_hard_negatives(spark, blocks, spread):
    rows = whole_rows(spread=spread)  # a spread of 1 gives many ties and scores of zero
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, label int, vector array<bigint>, id string").repartition(4)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **blocks)
    assert sorted(map(tuple, got.collect())) == negatives_by_force(rows)


def test_hard_negatives_beyond_doubles(spark):
    rows = [(i, i % 2, [2**29 + i, 3**18 - i]) for i in range(0, 130, 2)] + [(i, i % 3, [2**28 - i, i]) for i in range(1, 60, 2)]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<bigint>")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_force(rows)


def test_hard_negatives_odd_rows(spark):
    rows = whole_rows(150)
    odd = [(3, rows[3][1], rows[3][2]), (None, 1, rows[0][2]), (200, None, rows[0][2]), (300, 1, None), (400, 1, [1, None, 1, 1, 1]), (500, 1, [1])]
    schema = "vec_id long, label int, vector array<bigint>"
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows + odd, schema), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == negatives_by_force(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, 1, [1, 2])], schema)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_mining_rows_move_labels(spark):
    rows = mining_rows(spark.createDataFrame([(7, [0.5, -0.001], 9), (8, [1.0, 0.0], None), (9, [math.nan], 1)], "vec_id long, embedding array<float>, label int"))
    assert [tuple(r) for r in rows.collect()] == [(7, 0, [128, -1]), (8, None, [256, 0]), (9, 1, None)]


def test_whitening(spark):
    rows = [r for r in some_rows() if r[0] is None or r[0] < 1500]
    got = whitening.whiten(table(spark, rows), components=5).collect()
    fit = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, _ in rows if good(v)]
    x = np.array([v for _, v in fit])
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:5], axes[:, ::-1][:, :5]
    want = centred @ axes / np.sqrt(values)
    deviation = ((n * x - sums) ** 2).sum(1)
    assert len(got) == n * 5
    by_id = defaultdict(set)
    signs = defaultdict(set)
    for k, (i, _) in enumerate(fit):
        for c in range(5):
            by_id[i, c + 1].add((int(deviation[k]), round(abs(want[k, c]), 7)))
            if abs(want[k, c]) > 1e-3 and i is not None and i < 240:
                signs[i, c + 1] = math.copysign(1, want[k, c])
    flips = defaultdict(set)
    for r in got:
        assert (r["deviation"], round(abs(r["whitened"]), 7)) in by_id[r["vec_id"], r["component"]]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-9
        if isinstance(sign := signs.get((r["vec_id"], r["component"])), float):
            flips[r["component"]].add(sign * math.copysign(1, r["whitened"]))
    assert all(len(f) == 1 for f in flips.values())


def test_whitening_without_variance(spark):
    def out(rows):
        return whitening.whiten(table(spark, rows)).collect()

    assert out([]) == out([(1, [1.0, 2.0], 0)]) == out([(i, [1.0, 2.0], 0) for i in range(5)]) == out([(1, None, 0)]) == []
    line = out([(i, [float(i), 2.0 * i, 1.0], 0) for i in range(6)])  # one direction only
    assert {r["component"] for r in line} == {1} and abs(sum(r["whitened"] ** 2 for r in line) / 6 - 1) < 1e-9


@pytest.mark.parametrize("spectrum", ["falling", "equal", "near", "one large", "low rank"])
def test_leading_eigenvectors(spectrum):
    rng = np.random.default_rng(2)
    values = {
        "falling": 1.0 / np.arange(1, 151) ** 2,
        "equal": np.ones(150),
        "near": 1 + 1e-6 * rng.random(150),
        "one large": np.r_[1e4, 1 + 1e-3 * rng.random(149)],
        "low rank": np.r_[np.ones(4), np.zeros(146)],
    }[spectrum]
    axes = np.linalg.qr(rng.normal(size=(150, 150)))[0]
    whole = (axes * values) @ axes.T
    found, vectors, passes = whitening.leading(lambda q: whole @ q, 150, 20)
    assert np.abs(found - np.sort(values)[::-1][:20]).max() < 1e-11 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12
    assert np.linalg.norm(whole @ vectors - vectors * found, axis=0).max() <= 1e-11 * values.max()
    assert passes < 150


def test_sums_beyond_64_bits():
    x = np.array([[2**40, 5], [0, 1]])
    assert whitening.deviations(x, 2, [2**40, 6]) == [None, None]
    assert whitening.deviations(np.array([[3, 5], [1, 1]]), 2, [4, 6]) == [4 + 16, 4 + 16]


@pytest.mark.parametrize("name", ["op12_secondary_sort_negatives", "op13_pigeonhole_dedup"])
def test_same_as_sql(name, spark, sf_dir):
    run, sql = QUERIES[name]
    assert sql in (HARD_NEGATIVES_SQL, NEAR_VECTORS_SQL)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    status, _, _, detail = compare(spark, con, run, sql, sf_dir)
    assert status.startswith("ok"), (status, detail)
