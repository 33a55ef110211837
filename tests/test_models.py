"""Closed forms, quality on a planted signal, and storage of every model family."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.models import adaboost, boosting, native, trees
from tabloom.models.base import load_model
from tabloom.models.registry import CLASSIFIERS, REGRESSORS, SPACES, fit_model
from tabloom.operators import metrics
from tabloom.plans import search

N = 400
RNG = np.random.default_rng(7)
X = np.round(RNG.normal(size=(N, 3)), 4)
Y = 2.0 * X[:, 0] - X[:, 1] + 0.1 * RNG.normal(size=N)
TWO = (Y > 0).astype(float)
THREE = np.digitize(Y, [-1.0, 1.0]).astype(float)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(str(i), x.tolist(), float(y), float(a), float(b)) for i, (x, y, a, b) in enumerate(zip(X, Y, TWO, THREE))]
    df = spark.createDataFrame(rows, "row_key string, x array<double>, y double, two double, three double")
    return df.withColumn("features", array_to_vector("x")).drop("x").repartition(3).cache()


def labelled(table, label):
    return table.select("row_key", F.col(label).alias("label"), "features")


SMALL = {"n_estimators": 4, "max_depth": 3}


def options(name):
    has_trees = "n_estimators" in SPACES[name]
    found = dict(SMALL) if has_trees else {}
    if name.startswith("Ada"):
        found.pop("max_depth")
    return found


@pytest.mark.parametrize("name", [n for n in REGRESSORS if n not in ("Lasso", "ElasticNet")])
def test_regressors_beat_the_mean(table, name):
    rows = labelled(table, "y")
    params = {**options(name), **({"learning_rate": 0.5} if "XGB" in name or "Gradient" in name else {})}
    model = fit_model(name, rows, params)
    assert metrics.regression_metrics(model.predict(rows)).first()["r2"] > 0.5


@pytest.mark.parametrize("label,classes", [("two", 2), ("three", 3)])
@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifiers_beat_the_majority(table, name, label, classes):
    rows = labelled(table, label)
    scored = fit_model(name, rows, options(name), classes).predict(rows)
    total = F.aggregate("scores", F.lit(0.0), lambda t, x: t + x)
    row = scored.agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
        F.min(total).alias("low"),
        F.max(total).alias("high"),
        F.min(F.size("scores")).alias("width"),
    ).first()
    majority = max(np.bincount(TWO.astype(int) if classes == 2 else THREE.astype(int))) / N
    assert row["accuracy"] > majority + 0.1
    assert row["low"] == pytest.approx(1.0) and row["high"] == pytest.approx(1.0) and row["width"] == classes


@pytest.mark.parametrize("loss", ["absolute_error", "huber", "quantile"])
def test_gradient_boosting_losses(table, loss):
    rows = labelled(table, "y")
    model = fit_model("GradientBoostingRegressor", rows, {**SMALL, "loss": loss, "learning_rate": 0.5, "n_estimators": 6})
    scored = model.predict(rows)
    if loss == "quantile":
        below = scored.agg(F.avg((F.col("label") <= F.col("prediction")).cast("double"))).first()[0]
        assert 0.8 < below <= 0.98
    else:
        assert metrics.regression_metrics(scored).first()["r2"] > 0.6


def test_exponential_loss_needs_two_classes(table):
    with pytest.raises(ValueError):
        fit_model("GradientBoostingClassifier", labelled(table, "three"), {"loss": "exponential"}, 3)


def design(intercept=True):
    return np.column_stack([X, np.ones(N)]) if intercept else X


def test_linear_family_closed_forms(table):
    rows = labelled(table, "y")
    plain = fit_model("LinearRegression", rows).model
    want = np.linalg.lstsq(design(), Y, rcond=None)[0]
    assert np.allclose([*plain.coefficients, plain.intercept], want, atol=1e-6)
    ridge = fit_model("Ridge", rows, {"alpha": 50.0}).model
    centred, y = X - X.mean(0), Y - Y.mean()
    assert np.allclose(ridge.coefficients, np.linalg.solve(centred.T @ centred + 50 * np.eye(3), centred.T @ y), atol=1e-3)
    for name, params, ratio in (("Lasso", {"alpha": 0.2}, 1.0), ("ElasticNet", {"alpha": 0.2, "l1_ratio": 0.5}, 0.5)):
        w = np.zeros(3)
        for _ in range(500):
            for j in range(3):
                rho = centred[:, j] @ (y - centred @ w + centred[:, j] * w[j]) / N
                w[j] = np.sign(rho) * max(abs(rho) - 0.2 * ratio, 0) / ((centred[:, j] ** 2).mean() + 0.2 * (1 - ratio))
        assert np.allclose(fit_model(name, rows, params).model.coefficients, w, atol=1e-3)


def test_nonnegative_least_squares(table):
    model = fit_model("LinearRegression", labelled(table, "y"), {"positive": True})
    assert model.weights[0] > 1.5 and model.weights[1] == 0.0 and min(model.weights) >= 0.0


def test_logistic_matches_newton(table):
    model = fit_model("LogisticRegression", labelled(table, "two"), {"C": 0.1}).model
    z, w = design(), np.zeros(4)
    penalty = np.diag([10.0, 10.0, 10.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - TWO) + penalty @ w)
    assert np.allclose([*model.coefficients, model.intercept], w, atol=1e-3)


def test_tree_growth_in_pieces(table, monkeypatch):
    rows = labelled(table, "three")
    whole = fit_model("XGBClassifier", rows, {"n_estimators": 1, "max_depth": 2}, 3)
    monkeypatch.setattr(trees, "HISTOGRAM_CELLS", 1)
    pieces = fit_model("XGBClassifier", rows, {"n_estimators": 1, "max_depth": 2}, 3)
    for a, b in zip(whole.rounds[0], pieces.rounds[0]):
        assert a.feature == b.feature and a.cut == b.cut and np.allclose(a.value, b.value)


def test_deep_trees_keep_the_node_of_each_row(table, monkeypatch):
    rows = labelled(table, "three")
    assert native._tree_options({})["cacheNodeIds"] and not native._tree_options({"max_depth": 8})["cacheNodeIds"]
    kept = fit_model("DecisionTreeClassifier", rows, {}, 3).model
    monkeypatch.setattr(native, "SHALLOW", 30)
    sent = fit_model("DecisionTreeClassifier", rows, {}, 3).model
    assert kept.depth > 2 and kept.toDebugString.split("\n")[1:] == sent.toDebugString.split("\n")[1:]


def test_checkpoints_do_not_change_the_fit(table, monkeypatch):
    rows, params = labelled(table, "y"), {"n_estimators": 3, "max_depth": 2}
    plain = fit_model("XGBRegressor", rows, params)
    ada = fit_model("AdaBoostRegressor", rows, {"n_estimators": 3})
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 1)
    monkeypatch.setattr(adaboost, "CHECKPOINT_ROUNDS", 1)
    again = fit_model("XGBRegressor", rows, params)
    assert np.allclose(plain.rounds[-1][0].value, again.rounds[-1][0].value)
    assert np.allclose(fit_model("AdaBoostRegressor", rows, {"n_estimators": 3}).votes, ada.votes)


@pytest.mark.parametrize(
    "name,label",
    [
        ("DecisionTreeClassifier", "two"),
        ("XGBClassifier", "three"),
        ("AdaBoostClassifier", "three"),
        ("AdaBoostRegressor", "y"),
        ("KNeighborsRegressor", "y"),
        ("SVC", "two"),
        ("SVR", "y"),
    ],
)
def test_saved_models_predict_the_same(spark, table, tmp_path, name, label):
    rows = labelled(table, label)
    model = fit_model(name, rows, {"n_estimators": 2}, 3 if label == "three" else 2)
    model.save(spark, str(tmp_path / "m"))
    before = {r["row_key"]: r["prediction"] for r in model.predict(rows).collect()}
    after = {r["row_key"]: r["prediction"] for r in load_model(spark, str(tmp_path / "m")).predict(rows).collect()}
    assert before == after


def test_grid_sampling():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    every = search.sample_grid(space, 100)
    assert len(every) == 6 and len({tuple(sorted(p.items())) for p in every}) == 6
    assert search.sample_grid(space, 4, 1) == search.sample_grid(space, 4, 1)
    assert len(search.sample_grid(SPACES["RandomForestClassifier"], 100)) == 100


def test_random_search_picks_the_best(table):
    best, trials = search.random_search(
        labelled(table, "y"), "Ridge", "regression", space={"alpha": [0.01, 1e6]}, n_iter=5, n_splits=3
    )
    assert best == {"alpha": 0.01}
    assert trials.count() == 2


def test_refused_combinations_are_listed(table):
    best, trials = search.random_search(
        labelled(table, "three"), "GradientBoostingClassifier", "classification", 3,
        {"loss": ["exponential"]}, 2, 2,
    )
    assert best == {} and trials.first()["score"] is None


def _jobs_of(spark, name, work):
    """What `work` returns, and the number of Spark jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    found = work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("name,label,eps", [("SVR", "y", 0.1), ("SVC", "two", None)])
def test_support_vectors_reach_the_optimum_in_few_passes(spark, table, name, label, eps):
    rows = labelled(table, label).localCheckpoint()
    model, jobs = _jobs_of(spark, name, lambda: fit_model(name, rows, {}, 2))
    assert jobs < 150
    data = rows.collect()
    x, y = np.array([r["features"].toArray() for r in data]), np.array([r["label"] for r in data])
    raw, projection = model.mapping.raw()
    phi = raw(x) @ projection
    fit = model if name == "SVR" else model.margins[0]
    w, b = (fit.weights, fit.intercept) if name == "SVR" else (fit["weights"], fit["intercept"])

    def cost(w, b):
        value = phi @ w + b
        loss = np.maximum(np.abs(y - value) - eps, 0) if name == "SVR" else np.maximum(1 - (2 * y - 1) * value, 0)
        return 0.5 * np.dot(w, w) + loss.sum()

    least, rng = cost(np.array(w), b), np.random.default_rng(1)
    for size in (1e-3, 1e-2, 1e-1):
        for _ in range(200):
            assert cost(w + size * rng.normal(size=len(w)), b + size * rng.normal()) > least - 1e-3 * least


def test_batches_are_read_without_an_object_for_each_row():
    """Bytes and arrays of a sliced Arrow batch come as matrices."""
    import pyarrow as pa

    from tabloom.models.trees import Batch, unpack

    codes, margin = np.arange(12, dtype=np.uint8).reshape(4, 3), np.arange(8.0).reshape(4, 2)
    table = pa.RecordBatch.from_pydict({"bins": [r.tobytes() for r in codes], "margin": margin.tolist(), "label": [0.0, 1.0, 2.0, 3.0]})
    batch = Batch(table.slice(1, 2))
    assert len(batch) == 2 and (unpack(batch["bins"], 3) == codes[1:3]).all()
    assert (batch["margin"] == margin[1:3]).all() and batch["label"].tolist() == [1.0, 2.0]
