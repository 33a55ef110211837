"""The two public calls, as a user of a one-call tool makes them."""

import importlib.metadata
import tomllib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tabloom import api
from tabloom.functions.hashing import u01
from tabloom.models.base import load_model, read_json

MODELS = ["LinearRegression", "Ridge", "DecisionTreeRegressor"]


@pytest.fixture(scope="module")
def scores_csv(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "scores.csv")
    group = F.element_at(F.array(*map(F.lit, ["A", "B", "C"])), (F.col("id") % 3 + 1).cast("int"))
    df = spark.range(240).select(
        group.alias("group"), (u01("id") * 50).alias("reading"), F.when(F.col("id") % 40 == 0, F.lit("?")).otherwise((F.col("id") % 7).cast("string")).alias("lunch"),
        (u01("id") * 40 + F.col("id") % 3 * 5 + 10).alias("math_score"),
    )
    df.coalesce(1).write.option("header", True).csv(path)
    return path


@pytest.fixture(scope="module")
def run(spark, scores_csv, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run"))
    return api.train_model(
        scores_csv, "math_score", rmse_prob=0.3, f1_prob=0.7, n_jobs=-1, n_iter=2, n_splits=2, artifacts_dir=out, models=MODELS, curves=False
    )


def test_train_model(run):
    assert run["status"] == "success" and "status" in run
    board = run.leaderboard.collect()
    assert {r["model"] for r in board} <= set(MODELS) and run.report["model"] == board[0]["model"]
    assert run.report["test_r2"] > 0.8


def test_predict_by_folder_and_by_three_paths(run, scores_csv):
    by_folder = api.predict(run.path, scores_csv, clean=True)
    by_paths = api.predict(f"{run.path}/model.pkl", f"{run.path}/preprocessor.pkl", scores_csv, clean=True)
    assert "prediction" in by_folder and "prediction" in by_paths
    a, b = (sorted(map(tuple, p.df.collect()), key=repr) for p in (by_folder, by_paths))
    assert a == b and len(a) == 240
    assert set(by_paths.df.columns) >= {"group", "reading", "lunch", "prediction"}


def test_stored_model_scores_alike(spark, run):
    """The stored model gives the predictions of the one in hand."""
    again = load_model(spark, f"{run.path}/model")
    rows = run.prepared.data.where("is_test")
    here, there = (m.predict(rows).agg(F.sum("prediction"), F.count("*")).first() for m in (run.model, again))
    assert abs(here[0] - there[0]) < 1e-9 and here[1] == there[1] > 0


def test_stored_report(spark, run):
    stored = read_json(spark, f"{run.path}/report/json")
    assert stored["model"] == run.report["model"] and set(stored) == set(run.report)


def test_commands_name_the_jobs():
    project = tomllib.loads((Path(__file__).resolve().parent.parent / "pyproject.toml").read_text())
    for target in project["project"]["scripts"].values():
        entry = importlib.metadata.EntryPoint("x", target, "console_scripts")
        assert callable(entry.load())
