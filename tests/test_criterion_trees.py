"""Trees by absolute error and by Poisson deviance, against exhaustive single-process trees."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.models import criterion_trees
from tabloom.models.base import load_model
from tabloom.models.registry import fit_model

RNG = np.random.default_rng(5)
X = RNG.integers(0, 12, size=(300, 3)).astype(float)
Y = np.round(np.abs(3 * (X[:, 0] > 5) + X[:, 1] / 4 + RNG.exponential(1.0, 300) * (X[:, 2] > 3)), 1)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(str(i), x.tolist(), float(y)) for i, (x, y) in enumerate(zip(X, Y))]
    return spark.createDataFrame(data, "row_key string, x array<double>, label double").withColumn("features", array_to_vector("x"))


def cost(y, criterion):
    if criterion == "absolute_error":
        return np.abs(y - np.median(y)).sum()
    return -y.sum() * np.log(y.mean()) if y.sum() > 0 else np.inf


def exhaustive(x, y, criterion, depth, leaf):
    """Predictions of the greedy tree: the best cut of all, the least feature and value on a tie."""
    best = (1e-9, None, None)
    if depth:
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                low = x[:, j] <= v
                if min(low.sum(), (~low).sum()) < leaf:
                    continue
                gain = cost(y, criterion) - cost(y[low], criterion) - cost(y[~low], criterion)
                if gain > best[0] + 1e-9:
                    best = (gain, j, v)
    if best[1] is None:
        return np.full(len(y), np.median(y) if criterion == "absolute_error" else y.mean())
    low, out = x[:, best[1]] <= best[2], np.empty(len(y))
    for side in (low, ~low):
        out[side] = exhaustive(x[side], y[side], criterion, depth - 1, leaf)
    return out


@pytest.mark.parametrize("criterion", ["absolute_error", "poisson"])
def test_against_an_exhaustive_tree(spark, rows, criterion, tmp_path):
    model = fit_model("DecisionTreeRegressor", rows, {"criterion": criterion, "max_depth": 3, "min_samples_leaf": 4})
    got = {int(r["row_key"]): r["prediction"] for r in model.predict(rows).collect()}
    assert np.allclose([got[i] for i in range(len(Y))], exhaustive(X, Y, criterion, 3, 4))
    model.save(spark, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m")).predict(rows).collect()
    assert {int(r["row_key"]): r["prediction"] for r in again} == got


def test_quantile_levels_stay_close(rows, monkeypatch):
    """With 16 levels for some 60 labels the error of the tree stays near that of exact levels."""
    errors = []
    for levels in (256, 16):
        monkeypatch.setattr(criterion_trees.grow_absolute, "__defaults__", (levels,))
        model = fit_model("DecisionTreeRegressor", rows, {"criterion": "absolute_error", "max_depth": 3})
        errors.append(model.predict(rows).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0])
    assert errors[1] < 1.05 * errors[0]
    scored = model.predict(rows).groupBy("prediction").agg(F.percentile("label", 0.5).alias("middle")).collect()
    assert len(scored) > 3 and all(abs(r["prediction"] - r["middle"]) < 1e-9 for r in scored)


def test_distances():
    labels = np.array([0.0, 1.5, 4.0, 9.0])
    counts = RNG.integers(0, 4, size=(40, 4)).astype(float)
    want = [np.abs(v - np.median(v)).sum() if len(v) else 0.0 for v in (np.repeat(labels, c.astype(int)) for c in counts)]
    assert np.allclose(criterion_trees.distances(counts, counts * labels), want)


def test_edges(spark, rows):
    with pytest.raises(ValueError):
        fit_model("DecisionTreeRegressor", rows.withColumn("label", -F.col("label")), {"criterion": "poisson"})
    flat = rows.withColumn("label", F.lit(2.5))
    for criterion in ("absolute_error", "poisson"):
        model = fit_model("DecisionTreeRegressor", flat, {"criterion": criterion, "max_features": "sqrt"})
        assert [r[0] for r in model.predict(flat).select("prediction").distinct().collect()] == [2.5]
