"""Operators against brute force, with hot groups and with their large-data paths forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.operators import balance, neighbors, quantiles, ranking, running, split


def hot_classes(spark, n=3000):
    """One class holds 80 percent of the rows."""
    label = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").otherwise("c")
    return spark.range(n).select("id", label.alias("label"))


@pytest.mark.parametrize("tight", [False, True])
def test_stratified_holdout_matches_ranking(spark, monkeypatch, tight):
    if tight:
        monkeypatch.setattr(ranking, "BUCKETS", 4)
        monkeypatch.setattr(ranking, "RANKED_ROWS", 5)
    df = hot_classes(spark)
    held = split.stratified_holdout(df, "label", "id").toPandas()
    hashed = ranking.with_hash_order(df, "id").toPandas()
    assert held.is_test.sum() == 900
    for value, part in hashed.groupby("label"):
        ordered = part.sort_values([ranking.ORDER, "id"]).id.tolist()
        chosen = set(held[(held.label == value) & ~held.is_test].id)
        assert chosen == set(ordered[: len(chosen)])
        assert len(chosen) == round(0.7 * len(part))


def test_class_without_train_quota_is_test(spark):
    rows = [(i, "a") for i in range(4)] + [(4, "b")]
    df = spark.createDataFrame(rows, "id long, label string")
    held = split.stratified_holdout(df, "label", "id", 0.6).toPandas()
    assert held.is_test.sum() == 3
    assert split.random_holdout(df.limit(1), "id").first()["is_test"]


def test_folds_cover_all_rows_once(spark):
    df = hot_classes(spark, 1003)
    folds = split.stratified_folds(df, "label", "id", 4).toPandas()
    assert len(folds) == 1003 and folds.id.is_unique
    sizes = folds.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1
    per_class = folds.groupby(["label", "fold"]).size().unstack()
    assert (per_class.max(axis=1) - per_class.min(axis=1)).max() <= 1
    plain = split.random_folds(df, "id", 7).groupBy("fold").count().toPandas()
    assert sorted(plain["count"]) == [143, 143, 143, 143, 143, 144, 144]


def test_folds_of_tiny_classes(spark):
    rows = [(i, "a") for i in range(3)] + [(10, "b"), (11, "c"), (12, "c")]
    df = spark.createDataFrame(rows, "id long, label string")
    folds = split.stratified_folds(df, "label", "id", 4).toPandas()
    sizes = folds.groupby("fold").size().reindex(range(4), fill_value=0)
    assert sizes.sum() == 6 and sizes.max() - sizes.min() <= 1


def test_contiguous_folds_with_uneven_keys(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKETS", 8)
    monkeypatch.setattr(ranking, "RANKED_ROWS", 10)
    keys = [(i,) for i in range(500)] + [(10**12 + i,) for i in range(3)]
    df = spark.createDataFrame(keys, "id long")
    folds = split.contiguous_folds(df, "id", 5).toPandas().sort_values("id")
    expected = np.repeat(range(5), [101, 101, 101, 100, 100])
    assert folds.fold.tolist() == expected.tolist()


def test_undersample_leaves_equal_classes(spark):
    counts = balance.undersample(hot_classes(spark), "label", "id").groupBy("label").count().toPandas()
    assert set(counts["count"]) == {300}


def test_dense_ordinals(spark):
    df = hot_classes(spark, 500)
    out = ranking.dense_ordinals(ranking.with_hash_order(df, "id"), ["label"], "n", buckets=16).toPandas()
    for _, part in out.groupby("label"):
        assert sorted(part.n) == list(range(len(part)))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_ranges(spark, monkeypatch, descending):
    monkeypatch.setattr(running, "SAMPLE_VALUES", 64)
    df = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("x"), (F.col("id") % 5).alias("w"))
    assert len(running.range_bounds(df, "x")) > 3
    got = running.running_totals(df, "x", {"t": "w"}, descending=descending).toPandas()
    got = got.sort_values("x", ascending=not descending)
    assert got.t.tolist() == got.w.cumsum().tolist()


def test_ordered_codes_of_texts(spark, monkeypatch):
    monkeypatch.setattr(running, "SAMPLE_VALUES", 64)
    values = sorted({f"v{i * 7919 % 1000}" for i in range(400)} | {"é", "Z", "ß"}, key=lambda s: s.encode())
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = {r["value"]: r["code"] for r in running.ordered_codes(df, "value", "code").collect()}
    assert got == {v: i for i, v in enumerate(values)}


@pytest.mark.parametrize("n", [1, 2, 7, 450, 2001])
def test_exact_quantiles(spark, monkeypatch, n):
    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 1e6, n), 3))
    df = spark.createDataFrame(pd.DataFrame({"x": values, "empty": [None] * n}), "x double, empty double")
    got = quantiles.exact_quantiles(df, ["x", "empty"], [0.25, 0.5, 0.75])
    assert np.allclose(got["x"], np.quantile(values, [0.25, 0.5, 0.75]))
    assert got["empty"] == [None, None, None]


def vectors_with_copies(n=600, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[rng.random(n) < 0.35] = x[0]  # a third of all rows are copies
    return x


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("block", [1024, 40])
def test_knn_join_is_exact(spark, monkeypatch, p, block):
    monkeypatch.setattr(neighbors, "MIN_BLOCK", block)
    monkeypatch.setattr(neighbors, "MAX_BLOCK", block)
    monkeypatch.setattr(neighbors, "PART_ROWS", 8)
    x = vectors_with_copies()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = neighbors.knn_join(df, df, 4, p, exclude_self=True).toPandas().sort_values(["query", "rank"])
    d = np.round((np.abs(x[:, None] - x[None]) ** p).sum(-1) ** (1 / p), 9)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :4]
    assert got.neighbor.to_numpy().reshape(-1, 4).tolist() == want.tolist()


@pytest.mark.parametrize("p", [1, 2, 3])
@pytest.mark.parametrize("rows, k", [(3, 5), (700, 1), (700, 9), (2000, 300)])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_nearest_in_a_block(p, rows, k, offset):
    rng = np.random.default_rng(rows + k)
    a, b = (np.round(rng.normal(size=(n, 3)), 1) + offset for n in (60, rows))
    d = np.round(neighbors.minkowski(a, b, p), neighbors.DIGITS)
    for bound in (np.full(60, np.inf), d.min(axis=1) + 0.2):
        query, found, distance = neighbors.nearest_in_block(a, bound, b, k, p)
        for i in range(60):
            want = [j for j in np.lexsort((np.arange(rows), d[i]))[:k] if d[i, j] <= bound[i]]
            got = found[query == i].tolist()
            assert got[: len(want)] == want and distance[query == i].tolist() == d[i, got].tolist()


@pytest.mark.parametrize("p", [1, 1.5, 2, 3, 4])
@pytest.mark.parametrize("shape", ["normal", "offset", "far row", "few values", "huge"])
def test_wide_rows_in_a_block(p, shape):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(70, 20)), rng.normal(size=(900, 20))
    if shape == "offset":
        a, b = a + 1e4, b + 1e4
    elif shape == "far row":
        b[5] = 1e6
    elif shape == "few values":
        a, b = np.round(a), np.round(b)
        a[:, 3:], b[:, 3:] = 0.0, 0.0
    elif shape == "huge":
        a, b = a * 1e30, b * 1e30
    d = np.round(neighbors.minkowski(a, b, p), neighbors.DIGITS)
    for bound in (np.full(70, np.inf), np.sort(d, axis=1)[:, 2], np.full(70, d.max())):
        query, found, distance = neighbors.nearest_in_block(a, bound, b, 6, p)
        for i in range(70):
            want = [j for j in np.lexsort((np.arange(900), d[i]))[:6] if d[i, j] <= bound[i]]
            got = found[query == i].tolist()
            assert got[: len(want)] == want and distance[query == i].tolist() == d[i, got].tolist()


@pytest.mark.parametrize("p, most", [(1, 0.12), (2, 0.02), (3, 0.2)])
def test_few_wide_rows_are_compared_one_coordinate_at_a_time(monkeypatch, p, most):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:300], x[300:]
    pairs = []

    def counted(name, size):
        own = getattr(neighbors, name, None)
        if own:
            monkeypatch.setattr(neighbors, name, lambda *args: pairs.append(size(*args)) or own(*args))

    for name in ("minkowski", "powers"):
        counted(name, lambda left, right, p: len(left) * len(right))
    counted("minkowski_pairs", lambda left, right, p: len(left))
    counted("_roughly", lambda left, right, rows, cols, p: len(rows))
    neighbors.nearest_in_block(a, np.sort(neighbors.minkowski(a, b, p), axis=1)[:, 5], b, 6, p)
    assert sum(pairs[1:]) < most * len(a) * len(b)


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0])
def test_products_of_a_block_come_in_small_tiles(monkeypatch, p):
    """Limited, loose and unlimited queries of one block, with tiles that end inside it."""
    monkeypatch.setattr(neighbors, "TILE_ROWS", 7)
    monkeypatch.setattr(neighbors, "TILE_COLUMNS", 33)
    rng = np.random.default_rng(8)
    b = rng.normal(size=(300, 16))
    a = np.vstack([b[:20], rng.normal(size=(81, 16))])
    every = np.round(neighbors.minkowski(a, b, p), neighbors.DIGITS)
    order = np.lexsort((np.broadcast_to(np.arange(300), every.shape), every))[:, :4]
    last = np.take_along_axis(every, order[:, 3:], axis=1)[:, 0]
    bound = np.select([np.arange(101) % 5 == 0, np.arange(101) % 7 == 0, np.arange(101) % 11 == 0], [np.inf, 1e3, last * 0.9], last)
    query, found, distance = neighbors.nearest_in_block(a, bound, b, 4, p)
    within = np.take_along_axis(every, order, axis=1) <= bound[:, None] + neighbors.SLACK
    assert np.array_equal(query, np.nonzero(within)[0]) and np.array_equal(found, order[within])
    assert np.array_equal(distance, np.take_along_axis(every, order, axis=1)[within])
    shapes, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda x, y, out: shapes.append(out.shape) or product(x, y, out=out))
    neighbors.nearest_in_block(a, last, b, 4, p)
    assert len(shapes) == 15 * 10 and max(n * m for n, m in shapes) == 7 * 33


def test_blocks_grow_with_the_root_of_the_rows():
    size = [neighbors.block_rows(n) for n in (1, 2_000, 20_000, 10**6, 10**9)]
    assert size == [1024, 1024, 2262, 16_000, 32_768]


def test_knn_join_inside_groups(spark):
    x = vectors_with_copies(200)
    rows = [(i, "a" if i % 3 else "b", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, grp string, vector array<double>")
    got = neighbors.knn_join(df, df, 3, 2, by="grp", exclude_self=True).toPandas()
    assert len(got) == 600
    assert all((q % 3 == 0) == (n % 3 == 0) for q, n in zip(got["query"], got["neighbor"]))


def test_smote_rows_lie_between_neighbours(spark):
    x = vectors_with_copies(300)
    rows = [(i, 1 if i % 8 == 0 else 0, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    made = balance.smote(df, "label", "id", "vector").toPandas()
    counts = pd.Series([r[1] for r in rows]).value_counts()
    assert len(made) == counts[0] - counts[1] and set(made.label) == {1}
    for r in made.itertuples():
        a, b = x[r.base], x[r.neighbor]
        assert r.base % 8 == 0 and r.neighbor % 8 == 0 and r.base != r.neighbor
        assert np.allclose(np.array(r.vector), a + r.gap * (b - a))


def test_smote_needs_more_rows_than_neighbours(spark):
    rows = [(i, 1 if i < 4 else 0, [float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    with pytest.raises(ValueError):
        balance.smote(df, "label", "id", "vector")


def test_tomek_links_are_mutual(spark):
    x = vectors_with_copies(300, seed=3)
    rows = [(i, int(i % 2), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1, kind="stable")[:, 0]
    want = {(i, int(j)) for i, j in enumerate(nn) if i < j and nn[j] == i and i % 2 != j % 2}
    got = {(r["a"], r["b"]) for r in balance.tomek_links(df, "label", "id", "vector").collect()}
    assert got == want
    kept = {r["id"] for r in balance.remove_tomek(df, "label", "id", "vector").collect()}
    assert kept == set(range(300)) - {i for pair in want for i in pair}


def test_running_totals_of_shared_scores(spark):
    """Groups that share their values are split by the values, not by the rows."""
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("score"), (F.col("id") % 3).alias("g"), F.lit(1).alias("one"))
    assert len(running.range_bounds(rows, "score")) > 30
    got = running.running_totals(rows, "score", {"total": "one"}, ["g"]).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values("score").total.tolist() == list(range(1, 20_001))
    assert running.range_bounds(rows.where("score < 1000"), "score") == []


def test_quantiles_widen_their_bracket(spark):
    rows = spark.range(2000).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    want = np.quantile(np.arange(2000.0) ** 2, [0.25, 0.5])
    assert np.allclose(quantiles.exact_quantiles(rows, ["x"], [0.25, 0.5], slack=0.0)["x"], want)


def test_block_search_skips_boxes_out_of_reach(monkeypatch):
    """In few dimensions the pairs that are compared grow with the queries, not with the block."""
    rng, pairs = np.random.default_rng(6), []
    rough = neighbors._compared
    monkeypatch.setattr(neighbors, "_compared", lambda a, limit, b, k, p: pairs.append(len(a) * len(b)) or rough(a, limit, b, k, p))
    for size in (4000, 16_000):
        a, b = rng.random((1000, 2)), rng.random((size, 2))
        for p in (1.0, 2.0, 3.0):
            pairs.clear()
            query, found, distance = neighbors.nearest_in_block(a, np.full(1000, np.inf), b, 5, p)
            assert sum(pairs) < 1000 * size / 2
            every = np.round(neighbors.minkowski(a, b, p), 9)
            assert (found.reshape(1000, 5) == np.argsort(every, axis=1, kind="stable")[:, :5]).all()


def test_single_precision_lets_every_neighbour_through():
    """Vectors far from the origin, nearly equal ones and powers that single precision cannot hold."""
    rng = np.random.default_rng(7)
    for scale, shift in ((1.0, 1e6), (1e-9, 0.0), (1e20, 0.0), (1.0, 0.0)):
        b = rng.normal(size=(800, 12)) * scale + shift
        b[400:] = b[:400] * (1 + 1e-10)
        a = b[::7]
        for p in (1.0, 3.0):
            query, found, distance = neighbors.nearest_in_block(a, np.full(len(a), np.inf), b, 6, p)
            every = np.round(neighbors.minkowski(a, b, p), 9)
            assert (found.reshape(len(a), 6) == np.argsort(every, axis=1, kind="stable")[:, :6]).all()
