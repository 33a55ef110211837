"""Deep classification trees: the nodes of Spark ML's tree, in few passes over the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.models import class_trees, native
from tabloom.models.base import FEATURES, KEY, LABEL
from tabloom.models.native import _columns, _tree_options, fit_tree


def rows(spark, n: int, classes: int = 2):
    """Noisy classes by two of five features: continuous ones, one with zeros, an indicator and a constant."""
    numbers = [F.rand(1), F.round(F.rand(2) * 20), F.when(F.rand(3) < 0.4, 0.0).otherwise(F.rand(4)), (F.rand(5) < 0.5).cast("double"), F.lit(3.0)]
    wide = spark.range(0, n, 1, 4).select("id", *[c.alias(f"f{i}") for i, c in enumerate(numbers)], F.rand(6).alias("noise"))
    label = F.floor((F.col("f0") + F.col("f2") + 0.3 * F.col("noise")) / 2.3 * classes).cast("double")
    vector = array_to_vector(F.array(*[f"f{i}" for i in range(5)])).alias(FEATURES)
    return wide.select(F.col("id").cast("string").alias(KEY), label.alias(LABEL), vector).localCheckpoint()


def stored(spark, model, path):
    model.write().overwrite().save(str(path))
    return [tuple(r) for r in spark.read.parquet(f"{path}/data").orderBy("id").collect()]


# 20,000 rows are more than Spark ML looks at for cut points.
@pytest.mark.parametrize("n, classes, params", [(3_000, 2, {}), (3_000, 3, {"min_samples_leaf": 3, "max_depth": 12}), (20_000, 2, {"max_depth": 11})])
def test_nodes_are_those_of_spark_ml(spark, tmp_path, monkeypatch, n, classes, params):
    """Some levels over all rows, the rest in several tasks."""
    monkeypatch.setattr(class_trees, "LOCAL_ROWS", n // 6)
    monkeypatch.setattr(class_trees, "UNIT_ROWS", n // 12)
    train = rows(spark, n, classes)
    estimator = _columns(DecisionTreeClassifier(**_tree_options(params), impurity="gini"))
    found = stored(spark, class_trees.fit_deep_tree(train, estimator), tmp_path / "own")
    assert len(found) > 50 and found == stored(spark, estimator.fit(train), tmp_path / "ml")


@pytest.mark.parametrize("params", [{"max_features": 0.4, "max_depth": 11}, {"max_features": "log2", "max_depth": 13, "min_samples_leaf": 2}])
def test_feature_subsets_are_those_of_spark_ml(spark, tmp_path, monkeypatch, params):
    """The same draws for the same nodes, and a stored forest of one tree."""
    monkeypatch.setattr(class_trees, "SUBSET_ROWS", 0)
    train, found = rows(spark, 3_000), []
    subset = native.subset_strategy(params["max_features"])
    estimator = native._columns(
        RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=subset, **_tree_options(params), impurity="gini")
    )
    for name, model in (("own", class_trees.fit_deep_tree(train, estimator)), ("ml", estimator.fit(train))):
        model.write().overwrite().save(str(tmp_path / name))
        found.append([tuple(r) for r in spark.read.parquet(f"{tmp_path / name}/data").orderBy("nodeData.id").collect()])
        found.append([r["probability"].toArray().tolist() for r in model.transform(train).orderBy(KEY).limit(100).collect()])
    assert len(found[0]) > 20 and found[:2] == found[2:]


def test_balanced_classes_weigh_alike(spark):
    """Of rare and common rows that cannot be told apart, none outweighs the other."""
    train = rows(spark, 2_000).where((F.col(LABEL) == 0) | (F.col(KEY).cast("int") % 5 == 0))
    model = fit_tree(train, {"class_weight": "balanced", "max_depth": 12, "min_samples_leaf": 5}, True).model
    root = model._java_obj.rootNode().impurityStats().stats()
    assert model.getWeightCol() == "weight" and abs(root[0] - root[1]) < 1e-6 * root[0]


def test_draws_are_those_of_spark(spark):
    for seed in (42, -7, 123456789012345):
        theirs = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        own = class_trees.XorShift(seed)
        assert [own.int32(), own.double()] == [theirs.nextInt(), theirs.nextDouble()]


def test_a_tree_without_a_depth_limit_takes_few_jobs(spark):
    """Spark ML runs a job for each of some 20 levels."""
    train = rows(spark, 4_000)
    spark.sparkContext.setJobGroup("deep", "deep")
    try:
        model = fit_tree(train, {}, True).model
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("deep")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.depth > 12 and len(jobs) <= model.depth


def test_features_that_are_not_numbers_fail(spark):
    train = rows(spark, 500).withColumn(FEATURES, array_to_vector(F.array(F.lit(float("nan")), F.lit(1.0))))
    with pytest.raises(Exception, match="finite"):
        fit_tree(train, {}, True)


def test_one_class_is_left_to_spark_ml(spark):
    train = rows(spark, 200).withColumn(LABEL, F.lit(1.0))
    model = fit_tree(train, {}, True)
    assert {r["prediction"] for r in model.predict(train).collect()} == {1.0}


def test_thresholds_split_even_shares():
    """More values than bins: cuts lie at the middles nearest to equal shares."""
    values = np.arange(1.0, 1001.0)
    found = class_trees._thresholds(values, np.ones(1000), 1000.0, 4)
    assert found == [250.5, 500.5, 750.5]
