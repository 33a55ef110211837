"""Stored copies, size-checked broadcasts and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import materialize, stored_bytes

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
ROWS_PER_BUCKET = 5_000


def text_of(name: str = "text"):
    """The whole text; a missing one counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """A copy in the shared folder: runs once, cuts the lineage, survives lost executors."""
    return materialize(df, label)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, broadcast only if its counted rows stay under the bound.

    Beyond it the join that uses the table is a shuffle join, whose hot keys AQE splits.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def small_lists(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As `small_side`, for a stored table whose rows carry lists of any length: its bytes are bounded, too."""
    return small_side(df) if stored_bytes(df) <= max_bytes else df


def prefix_sums(df: DataFrame, group: str, order: list[str], value, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the same `group` that come before.

    Rows are ordered by a hash of `order`, then by `order` itself. No group meets in one
    task: rows are cut into hash buckets of about `ROWS_PER_BUCKET`, a window runs inside a
    bucket and the totals of the buckets before are added. `df` should be stored, as it is
    read twice; rows that agree in `order` must be interchangeable.
    """
    buckets = max(1, df.count() // ROWS_PER_BUCKET)
    rows = (
        df.withColumn("_value", value)
        .withColumn("_spread", F.xxhash64(F.lit(17), *order))
        .withColumn("_bucket", F.pmod("_spread", F.lit(buckets)))
    )
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(group, "_bucket")
        .agg(F.sum("_value").alias("_total"))
        .select(group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(group, "_bucket").orderBy("_spread", *order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(before, [group, "_bucket"])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_value", "_spread", "_bucket", "_before")
    )


def one_of_each(rows: DataFrame, slim: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` without repeats; only the keys that do occur more than once are shuffled for it."""
    again = stored(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats")
    if again.isEmpty():
        return rows
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))
    left, right = rows.alias("a"), small_side(again).alias("b")
    return left.join(right, same, "left_anti").unionByName(left.join(right, same, "left_semi").dropDuplicates(keys))
