"""What kind of table and target this is: class balance, task, roles, correlation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import quoted
from .clean import categorical_columns, is_categorical, numeric_columns

# Limits of the imbalance bands, of the task rule, of the correlation
# filter and of one-hot encoding.
MILD_LIMIT, MODERATE_LIMIT = 3, 20
CLASS_LIMIT = 20
CORRELATION_LIMIT = 0.85
ONE_HOT_LIMIT = 10


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(quoted(target)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def band(ratio: Column) -> Column:
    return F.when(ratio <= MILD_LIMIT, "mild").when(ratio <= MODERATE_LIMIT, "moderate").otherwise("none")


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: largest and smallest class, their ratio and the resampling band."""
    counts = class_counts(df.where(F.col(quoted(target)).isNotNull()), target)
    ends = counts.agg(F.max("n").alias("majority"), F.min("n").alias("minority"))
    return ends.withColumn("ratio", F.col("majority") / F.col("minority")).withColumn("band", band(F.col("ratio")))


def distinct_values(df: DataFrame, columns: list[str], exact_below: int) -> dict[str, int]:
    """Distinct counts that are exact wherever the value may lie near `exact_below`.

    A sketch settles the columns that are far above the limit; only the rest is counted.
    """
    if not columns:
        return {}
    rough = df.agg(*[F.approx_count_distinct(quoted(c), 0.05).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    result = {c: rough[f"d{i}"] for i, c in enumerate(columns)}
    near = [c for c in columns if result[c] <= 2 * exact_below + 10]
    if near:
        exact = df.agg(*[F.size(F.collect_set(quoted(c))).alias(f"d{i}") for i, c in enumerate(near)]).first()
        result.update({c: exact[f"d{i}"] for i, c in enumerate(near)})
    return result


def detect_tasks(df: DataFrame, targets: list[str]) -> list[tuple[str, str, bool]]:
    """(target, task, encode) per candidate target column."""
    text = set(categorical_columns(df))
    distinct = distinct_values(df, [t for t in targets if t not in text], CLASS_LIMIT)
    out = []
    for name in targets:
        if name in text:
            out.append((name, "classification", True))
        elif distinct[name] < CLASS_LIMIT:
            out.append((name, "classification", False))
        else:
            out.append((name, "regression", False))
    return out


def column_roles(df: DataFrame, target: str | None = None, skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    roles = []
    for f in df.schema.fields:
        if f.name == target or f.name in skip:
            continue
        roles.append((f.name, "categorical" if is_categorical(f.dataType) else "numeric"))
    return roles


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (a, b, pos_a, pos_b, r) of the Pearson matrix, a at or after b.

    Each pair uses the rows that have both values, whatever the number of columns. A column
    that is constant on those rows (its least value is its greatest) gives a null r.
    """
    columns = list(columns)
    pairs = _pair_sums(df, columns) if columns else {}
    rows = []
    for i in range(len(columns)):
        for j in range(i + 1):
            n, x, y, xx, yy, xy, flat = pairs.get((i, j), (0, 0.0, 0.0, 0.0, 0.0, 0.0, True))
            spread = (xx - x * x / n) * (yy - y * y / n) if n else 0.0
            value = None if flat or spread <= 0 else (xy - x * y / n) / spread**0.5
            rows.append((columns[i], columns[j], i, j, value))
    return df.sparkSession.createDataFrame(rows, "a string, b string, pos_a int, pos_b int, r double")


def _pair_sums(df: DataFrame, columns: list[str]) -> dict[tuple[int, int], tuple]:
    """n, sums, squares, products and flatness of each pair, in one pass after the centres.

    A task keeps one matrix per sum, so the shuffle has a row for each task and pair. Values
    are taken from the column's mean, which keeps the sums of squares exact enough.
    """
    doubles = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    centres = df.select(doubles).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))]).first()
    middle = np.array([0.0 if c is None else c for c in centres])
    k = len(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            if not len(batch):
                continue
            values = batch.to_numpy(dtype=np.float64, na_value=np.nan)
            known = ~np.isnan(values)
            z = np.where(known, values - middle, 0.0)
            has = known.astype(np.float64)
            # Entry (i, j) of x and xx concerns column i on the rows that have column j, too.
            n += has.T @ has
            x += z.T @ has
            xx += (z * z).T @ has
            xy += z.T @ z
            # Bounds of all columns on the rows that have column j: one pass serves the columns without gaps.
            below, above = np.where(known, values, np.inf), np.where(known, values, -np.inf)
            full = known.all(axis=0)
            low[:, full] = np.minimum(low[:, full], below.min(axis=0)[:, None])
            high[:, full] = np.maximum(high[:, full], above.max(axis=0)[:, None])
            for j in np.flatnonzero(~full & known.any(axis=0)):
                rows = known[:, j]
                low[:, j] = np.minimum(low[:, j], below[rows].min(axis=0))
                high[:, j] = np.maximum(high[:, j], above[rows].max(axis=0))
        i, j = np.tril_indices(k)
        yield pd.DataFrame(
            {
                "i": i.astype("int32"), "j": j.astype("int32"), "n": n[i, j], "x": x[i, j], "y": x[j, i],
                "xx": xx[i, j], "yy": xx[j, i], "xy": xy[i, j],
                "lx": low[i, j], "hx": high[i, j], "ly": low[j, i], "hy": high[j, i],
            }
        )

    sums = ("n", "x", "y", "xx", "yy", "xy")
    schema = "i int, j int, " + ", ".join(f"{c} double" for c in (*sums, "lx", "hx", "ly", "hy"))
    cells = df.select(doubles).mapInPandas(partial, schema).groupBy("i", "j")
    cells = cells.agg(
        *[F.sum(c).alias(c) for c in sums],
        ((F.min("lx") >= F.max("hx")) | (F.min("ly") >= F.max("hy"))).alias("flat"),
    )
    return {(r["i"], r["j"]): tuple(r[c] for c in (*sums, "flat")) for r in cells.collect()}


def correlated_columns(pairs: DataFrame, limit: float = CORRELATION_LIMIT) -> DataFrame:
    """Columns with an earlier column beyond the limit; an earlier dropped column counts."""
    strong = (F.col("pos_b") < F.col("pos_a")) & (F.abs("r") > limit)
    return pairs.where(strong).select(F.col("a").alias("column")).distinct()


@dataclass(frozen=True)
class Profile:
    task: str
    encode: bool
    band: str
    ratio: float


def profile(df: DataFrame, target: str) -> Profile:
    _, task, encode = detect_tasks(df, [target])[0]
    row = imbalance(df, target).first()
    return Profile(task, encode, row["band"], row["ratio"])


def text_and_numeric(df: DataFrame, target: str, skip: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    out = {target, *skip}
    return (
        [c for c in categorical_columns(df) if c not in out],
        [c for c in numeric_columns(df) if c not in out],
    )
