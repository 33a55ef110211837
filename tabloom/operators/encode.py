"""Feature encoding: one-hot, ordinal, standard scaling, label dictionaries.

Fitted statistics become literals, and value dictionaries become tables. A one-hot
column has at most ONE_HOT_LIMIT values, so encoding it is one projection; an ordinal
dictionary may be as long as the data has distinct values, so it is joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import quoted
from ..session import materialize, small_table
from .profile import ONE_HOT_LIMIT
from .running import ordered_codes

ONE_HOT, ORDINAL, SCALED = "OneHotEncoder", "OrdinalEncoder", "StandardScaler"


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs of several text columns, in one scan."""
    entries = [F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns]
    return (
        df.select(F.explode(F.array(*entries)).alias("e")).where("e.value is not null").select("e.*").distinct()
    )


def dictionary(values: DataFrame) -> DataFrame:
    """(column, value, code): codes 0..n-1 by ascending value inside each column."""
    return ordered_codes(values, "value", "code", ["column"])


def routing(df: DataFrame, columns: Sequence[str], limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """(column, n_values, encoder) by the number of distinct values."""
    counts = value_table(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    return counts.withColumn("encoder", F.when(F.col("n_values") > limit, ORDINAL).otherwise(ONE_HOT))


def join_code(df: DataFrame, codes: DataFrame, column: str, out: str, unseen: Column) -> DataFrame:
    """Look a value up in a (value, code) table."""
    renamed = codes.select(F.col("value").alias("__value"), F.col("code").cast("double").alias("__code"))
    joined = df.join(renamed, F.col(quoted(column)).cast("string") == F.col("__value"), "left")
    return joined.withColumn(out, F.coalesce("__code", unseen)).drop("__value", "__code")


def one_hot(column: str, values: Sequence[str], on_unseen: str = "error") -> list[Column]:
    """An indicator per value but the smallest; values ascending by code point."""
    value = F.col(quoted(column)).cast("string")
    known = value.isin(list(values))
    out = []
    for v in list(values)[1:]:
        if on_unseen == "error":
            failure = F.raise_error(F.concat(F.lit(f"unknown value in column {column}: "), F.coalesce(value, F.lit("null"))))
            indicator = F.when(known, F.when(value == v, 1.0).otherwise(0.0)).otherwise(failure.cast("double"))
        else:
            indicator = F.when(value == v, 1.0).otherwise(0.0)
        out.append(indicator.alias(f"{ONE_HOT}__{column}_{v}"))
    return out


def scaled(column: str, mean: float, std: float) -> Column:
    """(x - mean) / std with the population deviation; a constant column is only centred."""
    divisor = std if std and std > 0 else 1.0
    value = F.col(quoted(column)).cast("double")
    return ((value - F.lit(float(mean))) / F.lit(float(divisor))).alias(f"{SCALED}__{column}")


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        value = F.col(quoted(c)).cast("double")
        # Merged partial sums leave a tiny deviation on a constant column; its bounds are exact.
        flat = F.min(value) == F.max(value)
        aggs.append(F.when(flat, F.min(value)).otherwise(F.avg(value)).alias(f"m{i}"))
        aggs.append(F.when(flat, 0.0).otherwise(F.stddev_pop(value)).alias(f"s{i}"))
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


@dataclass
class Preprocessor:
    """Fitted encoding of one training table."""

    one_hot: dict[str, list[str]] = field(default_factory=dict)
    ordinal: list[str] = field(default_factory=list)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    codes: DataFrame | None = None

    @classmethod
    def fit(cls, train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], limit: int = ONE_HOT_LIMIT):
        categorical = list(categorical)
        fitted = cls(scale=moments(train, numeric))
        if categorical:
            values = materialize(value_table(train, categorical), "values")
            sizes = {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
            short = [c for c in categorical if sizes.get(c, 0) <= limit]
            fitted.ordinal = [c for c in categorical if c not in short]
            known: dict[str, list[str]] = {c: [] for c in short}
            if short:
                for row in values.where(F.col("column").isin(short)).collect():
                    known[row["column"]].append(row["value"])
            fitted.one_hot = {c: sorted(v, key=lambda s: s.encode("utf-8")) for c, v in known.items()}
            if fitted.ordinal:
                long = values.where(F.col("column").isin(fitted.ordinal))
                fitted.codes = small_table(dictionary(long))
        return fitted

    def state(self, spark: SparkSession) -> DataFrame:
        """(position, column, encoder, value, code, mean, std): all of the fitted state as one table."""
        schema = "position int, column string, encoder string, value string, code bigint, mean double, std double"
        place = {c: i for i, c in enumerate(self.inputs)}
        rows = [(place[c], c, ONE_HOT, v, i, None, None) for c, values in self.one_hot.items() for i, v in enumerate(values)]
        rows += [(place[c], c, SCALED, None, None, float(m), float(s)) for c, (m, s) in self.scale.items()]
        table = spark.createDataFrame(rows, schema)
        if self.ordinal:
            place_of = F.create_map(*[F.lit(v) for c in self.ordinal for v in (c, place[c])])
            coded = self.codes.select(
                F.element_at(place_of, F.col("column")).cast("int").alias("position"),
                "column",
                F.lit(ORDINAL).alias("encoder"),
                "value",
                F.col("code").cast("bigint").alias("code"),
                F.lit(None).cast("double").alias("mean"),
                F.lit(None).cast("double").alias("std"),
            )
            table = table.unionByName(coded)
        return table

    @classmethod
    def from_state(cls, table: DataFrame) -> "Preprocessor":
        """Rebuild from `state`; long dictionaries stay a table."""
        fitted = cls()
        short = table.where(F.col("encoder") != ORDINAL).orderBy("position", "code").collect()
        for row in short:
            if row["encoder"] == ONE_HOT:
                fitted.one_hot.setdefault(row["column"], []).append(row["value"])
            else:
                fitted.scale[row["column"]] = (row["mean"], row["std"])
        long = table.where(F.col("encoder") == ORDINAL)
        order = long.groupBy("position", "column").agg(F.count(F.lit(1)).alias("n")).orderBy("position").collect()
        fitted.ordinal = [r["column"] for r in order]
        if fitted.ordinal:
            fitted.codes = small_table(long.select("column", "value", "code"))
        return fitted

    @property
    def feature_columns(self) -> list[tuple[str, str, str | None]]:
        """(encoder, column, value) per output feature, in output order."""
        out = [(ONE_HOT, c, v) for c, values in self.one_hot.items() for v in values[1:]]
        out += [(ORDINAL, c, None) for c in self.ordinal]
        return out + [(SCALED, c, None) for c in self.scale]

    @property
    def feature_names(self) -> list[str]:
        return [f"{e}__{c}" if v is None else f"{e}__{c}_{v}" for e, c, v in self.feature_columns]

    @property
    def display_names(self) -> list[str]:
        return [c if v is None else f"{c} : {v}" for _, c, v in self.feature_columns]

    @property
    def inputs(self) -> list[str]:
        return [*self.one_hot, *self.ordinal, *self.scale]

    def wide(self, df: DataFrame, keep: Sequence[str] = (), on_unseen: str = "error") -> DataFrame:
        """One double column per feature next to the columns to keep."""
        missing = [c for c in self.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        coded = df
        for i, c in enumerate(self.ordinal):
            codes = self.codes.where(F.col("column") == c)
            coded = join_code(coded, codes, c, f"__code{i}", F.lit(-1.0))
        out = [F.col(quoted(k)) for k in keep]
        for c, values in self.one_hot.items():
            out += one_hot(c, values, on_unseen)
        out += [F.col(f"__code{i}").alias(f"{ORDINAL}__{c}") for i, c in enumerate(self.ordinal)]
        out += [scaled(c, *self.scale[c]) for c in self.scale]
        return coded.select(*out)

    def transform(self, df: DataFrame, keep: Sequence[str] = (), on_unseen: str = "error", out: str = "features") -> DataFrame:
        """The features as one vector column; a null feature fails the job."""
        wide = self.wide(df, keep, on_unseen)
        checked = []
        for name in self.feature_names:
            value = F.col(quoted(name))
            failure = F.raise_error(F.lit(f"missing value in feature {name}")).cast("double")
            checked.append(F.coalesce(value, failure))
        vector = array_to_vector(F.array(*checked)) if checked else array_to_vector(F.array().cast("array<double>"))
        return wide.select(*[F.col(quoted(k)) for k in keep], vector.alias(out))


def label_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(value, label): classes in ascending order as 0..k-1; numbers sort as numbers."""
    classes = df.select(F.col(quoted(label)).alias("value")).where("value is not null").distinct()
    coded = ordered_codes(classes, "value", "code")
    return small_table(coded.select("value", F.col("code").cast("double").alias("label")))


def encode_label(df: DataFrame, labels: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Add the class number; a class outside the dictionary fails the job."""
    lookup = labels.select(F.col("value").alias("__value"), F.col("label").alias("__label"))
    joined = df.join(lookup, F.col(quoted(column)) == F.col("__value"), "left")
    text = F.coalesce(F.col(quoted(column)).cast("string"), F.lit("null"))
    failure = F.raise_error(F.concat(F.lit("unknown class: "), text)).cast("double")
    return joined.withColumn(out, F.coalesce("__label", failure)).drop("__value", "__label")


def decode_label(df: DataFrame, labels: DataFrame, column: str = "prediction", out: str = "prediction") -> DataFrame:
    lookup = labels.select(F.col("value").alias("__value"), F.col("label").alias("__label"))
    joined = df.join(lookup, F.col(quoted(column)) == F.col("__label"), "left")
    return joined.withColumn(out, F.col("__value")).drop("__value", "__label") if out != column else (
        joined.drop(column).withColumnRenamed("__value", out).drop("__label")
    )


def class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Add n / (k * n_class), the balanced weight of each row's class."""
    counts = df.groupBy(F.col(quoted(label)).alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    weights = small_table(
        counts.select("__label", (F.lit(float(totals["n"])) / (F.col("__n") * totals["k"])).alias("__w"))
    )
    joined = df.join(weights, F.col(quoted(label)) == F.col("__label"))
    return joined.withColumn(out, F.col("__w")).drop("__label", "__w")
