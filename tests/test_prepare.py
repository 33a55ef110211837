"""Sources, cleaning, profiling and encoding on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabloom.functions.nulls import NULL_TOKENS, null_tokens
from tabloom.operators import clean, curves, encode, metrics, profile
from tabloom.sources import tables


def write_csv(path, text):
    path.write_text(text)
    return str(path)


def test_csv_types_follow_the_reader(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", "a,b,c,d,e\n1,x,True,?,NA\n2.5,,False,3,4\n-1e3,NaN,True,4,\n")
    df = tables.read_table(spark, path)
    assert dict(df.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "string", "e": "double"}
    rows = df.collect()
    assert [r["b"] for r in rows] == ["x", None, None]
    assert [r["c"] for r in rows] == [1.0, 0.0, 1.0]
    # The question mark made the column text; it stays text unless asked otherwise.
    assert clean.categorical_columns(null_tokens(df)) == ["b", "d"]
    assert dict(tables.retype_numbers(null_tokens(df)).dtypes)["d"] == "double"


def test_scoring_read_checks_columns(spark, tmp_path):
    path = write_csv(tmp_path / "s.csv", "a,extra\n1,2\n")
    assert tables.read_for_scoring(spark, path, {"a": "numeric"}).columns == ["a"]
    with pytest.raises(ValueError):
        tables.read_for_scoring(spark, path, {"a": "numeric", "b": "numeric"})


def test_tokens_are_exact(spark):
    values = [*NULL_TOKENS, " NA", "Na", "ok"]
    got = null_tokens(spark.createDataFrame([(v,) for v in values], "v string")).collect()
    assert [r["v"] for r in got] == [None] * len(NULL_TOKENS) + [" NA", "Na", "ok"]


def test_clean_fills_and_drops_duplicates(spark):
    rows = [("b", 1.0, None), ("a", None, None), (None, 3.0, None), ("b", 1.0, None), ("a", 9.0, None)]
    cleaned, fills = clean.clean(spark.createDataFrame(rows, "s string, x double, none string"))
    assert fills.modes == {"s": "a"} and fills.medians == {"x": 2.0} and fills.empty == ["none"]
    got = sorted(tuple(r) for r in cleaned.collect())
    assert got == [("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 1.0)]


def test_dates_and_booleans(spark):
    df = spark.sql("select date'2024-01-02' as d, true as b, 3 as i")
    assert dict(clean.canonical(df).dtypes) == {"d": "string", "b": "double", "i": "int"}
    assert clean.canonical(df).first()["d"] == "2024-01-02"


def test_correlation_of_constant_and_missing(spark):
    rows = [(float(i), 2.0 * i, 7.0, None if i % 3 else float(-i)) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    assert got["b", "a"] == pytest.approx(1.0) and got["c", "a"] is None and got["c", "c"] is None
    assert got["d", "a"] == pytest.approx(-1.0)
    dropped = {r[0] for r in profile.correlated_columns(profile.correlation_pairs(df, ["a", "b", "c", "d"])).collect()}
    assert dropped == {"b", "d"}


def test_task_and_band_limits(spark):
    df = spark.range(400).select(
        (F.col("id") % 19).alias("few"), (F.col("id") % 20).alias("many"), F.col("id").cast("string").alias("text")
    )
    assert [t[1:] for t in profile.detect_tasks(df, ["few", "many", "text"])] == [
        ("classification", False), ("regression", False), ("classification", True),
    ]
    for share, band in ((4, "mild"), (21, "moderate"), (22, "none")):
        rows = spark.range(share * 10).select((F.col("id") % share == 0).cast("int").alias("y"))
        assert profile.imbalance(rows, "y").first()["band"] == band


def test_encoding_of_unseen_and_odd_values(spark):
    train = spark.createDataFrame([("x_1", "only", 1.0), ("y", "only", 3.0), ("x_2", "only", 5.0)], "a string, b string, n double")
    fitted = encode.Preprocessor.fit(train, ["a", "b"], ["n"])
    assert fitted.feature_names == ["OneHotEncoder__a_x_2", "OneHotEncoder__a_y", "StandardScaler__n"]
    assert fitted.display_names == ["a : x_2", "a : y", "n"]
    wide = fitted.wide(train).collect()
    assert [tuple(r)[:2] for r in wide] == [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)]
    assert [r[2] for r in wide] == pytest.approx([-1.224744871, 0.0, 1.224744871])
    other = spark.createDataFrame([("new", "only", 1.0)], "a string, b string, n double")
    with pytest.raises(PySparkException):
        fitted.wide(other).collect()
    assert tuple(fitted.wide(other, on_unseen="zeros").first())[:2] == (0.0, 0.0)
    with pytest.raises(ValueError):
        fitted.wide(other.drop("n"))
    again = encode.Preprocessor.from_state(fitted.state(spark))
    assert again.one_hot == fitted.one_hot and again.scale == fitted.scale


def test_missing_feature_fails(spark):
    train = spark.createDataFrame([(1.0,), (2.0,)], "n double")
    fitted = encode.Preprocessor.fit(train, [], ["n"])
    with pytest.raises(PySparkException):
        fitted.transform(spark.createDataFrame([(None,)], "n double")).collect()


def test_unknown_class_fails(spark):
    labels = encode.label_dictionary(spark.createDataFrame([("b",), ("a",)], "y string"), "y")
    assert {r["value"]: r["label"] for r in labels.collect()} == {"a": 0.0, "b": 1.0}
    with pytest.raises(PySparkException):
        encode.encode_label(spark.createDataFrame([("c",)], "y string"), labels, "y").collect()


def test_metrics_without_positives(spark):
    scored = spark.createDataFrame([(0.0, 0.0, 0.1), (0.0, 0.0, 0.2)], "label double, prediction double, score double")
    row = metrics.binary_metrics(scored).first()
    assert (row["accuracy"], row["f1"], row["precision"], row["recall"]) == (1.0, 0.0, 0.0, 0.0)
    assert metrics.roc_auc(scored).first()["auc"] is None


def test_auc_counts_ties_half(spark):
    rows = [(1.0, 0.5), (0.0, 0.5), (1.0, 0.9), (0.0, 0.1)]
    scored = spark.createDataFrame(rows, "label double, score double")
    assert metrics.roc_auc(scored).first()["auc"] == pytest.approx(0.875)


def test_confusion_matrix_has_all_pairs(spark):
    scored = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 2.0)], "label double, prediction double")
    assert len(curves.confusion_matrix(scored).collect()) == 9


def test_density_integrates_to_one(spark):
    scored = spark.range(2000).select(F.randn(1).alias("label"), F.lit(0.0).alias("prediction"))
    rows = sorted(tuple(r) for r in curves.residual_kde(scored).select("x", "density").collect())
    assert np.trapezoid([d for _, d in rows], [x for x, _ in rows]) == pytest.approx(1.0, abs=0.02)


def test_constants_on_many_partitions(spark):
    """Merged partial sums leave a tiny deviation on a constant column; its bounds decide."""
    rows = spark.range(4000).select(
        "id", F.lit(0.1).alias("tenth"), F.lit(7.0).alias("flat"), (F.col("id") % 17).cast("double").alias("x")
    ).repartition(16, "id")
    pairs = {(r["a"], r["b"]): r["r"] for r in profile.correlation_pairs(rows, ["x", "tenth", "flat"]).collect()}
    assert pairs.pop(("x", "x")) == pytest.approx(1.0) and set(pairs.values()) == {None}
    assert profile.correlated_columns(profile.correlation_pairs(rows, ["x", "tenth", "flat"])).count() == 0
    fitted = encode.Preprocessor.fit(rows, [], ["tenth", "flat"])
    wide = fitted.wide(rows, ["id"]).drop("id")
    assert {tuple(r) for r in wide.distinct().collect()} == {(0.0, 0.0)}
    scored = rows.select(F.col("tenth").alias("label"), F.lit(0.2).alias("prediction"))
    assert metrics.regression_metrics(scored).first()["r2"] is None


@pytest.mark.parametrize("width", [3, 50])
def test_correlation_of_pairs_with_gaps(spark, width):
    """Each pair uses the rows that have both values, at any width."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, width)) + 1000.0
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"c{i}" for i in range(width)]
    rows = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_pairs(rows.repartition(5), names).collect()}
    want = pd.DataFrame(x, columns=names).corr()
    assert all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a, b in got)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert tables.read_table(spark, str(tmp_path / "t.csv"), multi_line=True).count() == 2


def test_wide_tables_are_not_broadcast(spark):
    from tabloom.session import small_table, stored_bytes

    rows = spark.range(300).select("id", F.expr("repeat(md5(cast(id as string)), 40)").alias("text"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(small_table(rows)) and "broadcast" not in plan(small_table(rows, max_bytes=1000))
    assert "broadcast" not in plan(small_table(rows, max_rows=10)) and stored_bytes(small_table(rows, max_rows=1)) > 1000
