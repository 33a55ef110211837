"""End to end: train, save, score, stream."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabloom.api import predict, train_model
from tabloom.functions.hashing import u01
from tabloom.jobs import score_job, train_job
from tabloom.plans import evaluate, search
from tabloom.plans import train as train_plan
from tabloom.plans.score import score
from tabloom.plans.train import prepare, train
from tabloom.queries.fixtures import fx_class
from tabloom.streaming.scoring import score_stream

FAST = {"n_iter": 1, "n_splits": 2}


def people(spark, n=240):
    """A clean signal, a text column, a copy, an empty column and some missing values."""
    u = u01("id")
    rows = spark.range(n).select(
        (u * 10).alias("x"),
        (u * 20 + 1).alias("twice"),
        F.when(F.col("id") % 9 != 0, u01("id", F.lit("z"))).alias("z"),
        F.when(F.col("id") % 3 == 0, "red").when(F.col("id") % 3 == 1, "blue").otherwise("?").alias("colour"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(5.0).alias("flat"),
        F.when(u > 0.6, "yes").otherwise("no").alias("answer"),
        (u * 3 + u01("id", F.lit("e"))).alias("amount"),
    )
    return rows


def test_classification_run(spark, tmp_path):
    df = people(spark).drop("amount")
    run = train_model(df, "answer", 0.3, 0.7, artifacts_dir=str(tmp_path), models=["LogisticRegression", "DecisionTreeClassifier"], **FAST)
    report = run.report
    assert run.status == "success" and report["problem_type"] == "classification"
    assert report["dropped_columns"] == ["twice"] and report["test_f1"] > 0.8
    assert report["categorical_features"] == ["colour"] and report["numerical_features"] == ["x", "z", "flat"]
    assert any("nothing" in w for w in report["warnings"])
    assert {"roc", "precision_recall", "confusion_matrix", "learning_curve", "class_distribution", "correlation"} <= set(run.curves)
    text = [r[0] for r in spark.read.text(f"{run.path}/report/text").collect()]
    assert f"model: {report['model']}" in text
    saved = spark.read.parquet(f"{run.path}/curves/confusion_matrix")
    assert saved.agg(F.sum("n")).first()[0] == run.prepared.data.where("is_test").count()
    # Scoring: texts come back, extra columns survive, a missing value or column fails.
    rows = people(spark).drop("answer").where("z is not null").withColumn("colour", F.lit("red"))
    scored = predict(run.path, rows)
    assert scored.columns == [*rows.columns, "prediction"]
    assert {r[0] for r in scored.select("prediction").distinct().collect()} == {"no", "yes"}
    right = scored.join(people(spark).select("x", "answer"), "x").agg(F.avg((F.col("prediction") == F.col("answer")).cast("double"))).first()[0]
    assert right > 0.85
    with pytest.raises(PySparkException):
        predict(run.path, people(spark).withColumn("colour", F.lit("red"))).collect()
    assert predict(run.path, people(spark), clean=True).count() == 240
    with pytest.raises(ValueError):
        predict(run.path, rows.drop("x"))
    # A stream of the same files gives the same rows.
    rows.select("x", "z", "colour", "flat").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, z double, colour string, flat double").parquet(str(tmp_path / "in"))
    query = score_stream(stream, run.path, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_regression_run_from_csv(spark, tmp_path):
    path = str(tmp_path / "people.csv")
    people(spark).drop("answer", "nothing").coalesce(1).write.option("header", True).csv(path)
    run = train(path, "amount", 0.3, 0.7, out=str(tmp_path), models=["LinearRegression", "Ridge", "KNeighborsRegressor"], spark=spark, **FAST)
    assert run.report["problem_type"] == "regression" and run.report["test_r2"] > 0.7
    assert {"residual_histogram", "residual_kde", "actual_vs_predicted", "learning_curve"} <= set(run.curves)
    assert run.leaderboard.count() == 6
    scored = score(path, run.path, spark, clean=True)
    assert scored.count() == 240 and scored.where("prediction is null").count() == 0


def test_moderate_imbalance_is_resampled_in_train_only(spark, sf_dir):
    df = fx_class(spark, sf_dir).drop("y", "level", "c_name")
    found = prepare(df, "high", key="o_orderkey")
    counts = {(r["is_test"], r["label"]): r["n"] for r in found.data.groupBy("is_test", "label").agg(F.count("*").alias("n")).collect()}
    assert found.band == "moderate"
    assert counts[True, 0.0] > 5 * counts[True, 1.0]
    assert counts[False, 1.0] == pytest.approx(counts[False, 0.0], rel=0.05)


def test_severe_imbalance_is_left_alone(spark):
    df = spark.range(500).select(u01("id").alias("x"), (F.col("id") % 50 == 0).cast("int").alias("y"))
    found = prepare(df, "y")
    assert found.band == "none" and found.data.count() == 500 and found.warnings


def test_a_class_with_one_row_is_refused(spark):
    df = spark.range(50).select(u01("id").alias("x"), F.when(F.col("id") == 0, "a").otherwise("b").alias("y"))
    with pytest.raises(ValueError):
        prepare(df, "y")


def test_train_scope_imputation(spark):
    found = prepare(people(spark).drop("amount", "nothing"), "answer", impute_scope="train")
    assert set(found.fills.medians) >= {"z"} and found.data.count() > 0


def test_same_split_for_any_partitioning(spark):
    df = people(spark).drop("amount")
    one = prepare(df.coalesce(1), "answer").data.toPandas().sort_values("row_key")
    many = prepare(df.repartition(7), "answer").data.toPandas().sort_values("row_key")
    assert one.row_key.tolist() == many.row_key.tolist() and one.is_test.tolist() == many.is_test.tolist()
    assert np.allclose(np.stack(one.features.map(lambda v: v.toArray())), np.stack(many.features.map(lambda v: v.toArray())))


def test_job_arguments(spark, tmp_path, capsys):
    a = train_job.parser().parse_args("--data-path d --target y --rmse-weight 0.3 --f1-weight 0.7 --fast".split())
    assert a.fast and a.n_iter == 100 and a.n_splits == 5
    path = str(tmp_path / "t.csv")
    people(spark).select("x", "z", "answer").write.option("header", True).csv(path)
    train_job.main(
        f"--data-path {path} --target answer --rmse-weight 0.3 --f1-weight 0.7 --n-iter 1 --n-splits 2 "
        f"--models DecisionTreeClassifier --out {tmp_path}".split()
    )
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["model"] == "DecisionTreeClassifier"
    score_job.main(f"--model-dir {tmp_path}/artifacts --input {path} --output {tmp_path}/scored --clean".split())
    assert spark.read.parquet(f"{tmp_path}/scored").count() == 240


def test_prefixes_are_counted_in_one_pass(spark, monkeypatch):
    """No scan for each prefix: sizes, and prefixes of one class or none, come from one grouped pass."""
    from pyspark.sql import DataFrame

    from tabloom.plans import evaluate

    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 1.0), (4, 1.0), (4, 0.0)], "step int, label double")
    assert evaluate.prefixes(rows, "classification", 5) == [(0, False), (2, False), (3, True), (3, True), (5, True)]
    assert evaluate.prefixes(rows, "regression", 3) == [(0, False), (2, True), (3, True)]

    asked, count = [], DataFrame.count
    monkeypatch.setattr(DataFrame, "count", lambda self: asked.append(self.columns) or count(self))
    monkeypatch.setattr(evaluate, "folded", lambda train, task, k: train)
    monkeypatch.setattr(evaluate, "fit_model", lambda *a: None)
    monkeypatch.setattr(evaluate, "single_score", lambda *a: 1.0)
    monkeypatch.setattr(evaluate, "discard", lambda df: None)
    train = spark.createDataFrame([(str(i), float(i % 2), [1.0], i % 2) for i in range(40)], "row_key string, label double, features array<double>, fold int")
    train = train.withColumn("label", (train.row_key.cast("int") % 4 > 1).cast("double"))
    curve = evaluate.learning_curve("DecisionTreeClassifier", {}, train, "classification", 2, 2)
    assert curve.agg({"rows": "max"}).first()[0] == 20 and not [c for c in asked if "features" in c or c == ["label"]]


def test_all_searches_share_the_folds(spark, monkeypatch):
    placed, scores = [], []

    def counted(*args):
        placed.append(evaluate.folded(*args))
        return placed[-1]

    def searched(*args, **named):
        shared = search.random_search(*args, **named)
        own = search.random_search(*args, **{**named, "folds": None})
        scores.append([sorted((r["trial"], r["score"]) for r in table.collect()) for _, table in (shared, own)])
        return shared

    monkeypatch.setattr(train_plan, "folded", counted)
    monkeypatch.setattr(train_plan, "random_search", searched)
    train(people(spark).drop("amount"), "answer", models=["LogisticRegression", "DecisionTreeClassifier"], curves=False, spark=spark, **FAST)
    assert len(placed) == 1 and len(scores) == 2 and all(a == b for a, b in scores)


def test_the_split_reads_a_stored_table(spark, sf_dir, monkeypatch):
    """The join behind the encoded rows runs once, not for each scan of the split."""
    from tabloom.queries import modelling

    seen, split = [], modelling.stratified_holdout
    monkeypatch.setattr(modelling, "stratified_holdout", lambda df, *a: seen.append(df.inputFiles()) or split(df, *a))
    modelling.encoded(spark, sf_dir, "classification")
    assert seen[0] and all("/tabloom/" in name for name in seen[0])
