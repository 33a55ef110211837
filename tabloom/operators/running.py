"""Running totals over a whole ordered table, without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import quoted

SAMPLE_VALUES = 8192
VALUES_PER_RANGE = 50_000
RANGES = (64, 1024)
HASHES = 2.0**64


def range_bounds(df: DataFrame, order: str) -> list:
    """Ascending split points of `order`, from the SAMPLE_VALUES distinct values of least hash.

    A second run of the plan sees the same points. How far these hashes reach into the hash
    space tells the number of distinct values, and from it follow the ranges. Fewer values than
    half the sample need no split, as no group can hold more rows than there are values.
    """
    value = F.col(quoted(order))
    hashed = df.select(value.alias("v")).distinct().withColumn("h", F.xxhash64("v"))
    least = hashed.orderBy("h").limit(SAMPLE_VALUES).collect()
    if len(least) < SAMPLE_VALUES // 2:
        return []
    reach = (least[-1]["h"] + HASHES / 2) / HASHES
    distinct = len(least) / reach if len(least) == SAMPLE_VALUES else len(least)
    ranges = min(max(RANGES[0], int(distinct // VALUES_PER_RANGE)), RANGES[1])
    sample = sorted((r["v"] for r in least if r["v"] is not None), key=_sort_key)
    step = max(1, len(sample) // ranges)
    return sample[step::step]


def _sort_key(value):
    return value.encode("utf-8") if isinstance(value, str) else value


def range_bucket(column: Column, bounds: Sequence) -> Column:
    """Bucket number by binary search: a nested CASE that stays inside codegen."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < F.lit(bounds[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(bounds))


def running_totals(
    df: DataFrame, order: str, totals: dict[str, str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Add, per output name, the inclusive running sum of a column in `order` order.

    `df` holds one row per (by..., order), that is, it is already aggregated. Rows are
    windowed per range of `order`, and the totals of the ranges before are added from a
    table with at most one row per (group, range).
    """
    by = list(by)
    bounds = range_bounds(df, order)
    value = F.col(quoted(order))
    sort = value.desc() if descending else value.asc()
    if not bounds:
        window = Window.partitionBy(*[quoted(b) for b in by] or [F.lit(0)]).orderBy(sort)
        return df.withColumns({out: F.sum(src).over(window) for out, src in totals.items()})

    bucketed = df.withColumn("__range", range_bucket(value, bounds))
    keys = [*map(quoted, by), "__range"]
    outer = F.col("__range").desc() if descending else F.col("__range").asc()
    before = (
        Window.partitionBy(*[quoted(b) for b in by] or [F.lit(0)])
        .orderBy(outer)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = bucketed.groupBy(*keys).agg(*[F.sum(src).alias(f"__t_{out}") for out, src in totals.items()])
    starts = starts.select(
        *keys, *[F.coalesce(F.sum(f"__t_{out}").over(before), F.lit(0)).alias(f"__s_{out}") for out in totals]
    )
    inner = Window.partitionBy(*keys).orderBy(sort)
    summed = bucketed.withColumns({f"__w_{out}": F.sum(src).over(inner) for out, src in totals.items()})
    joined = summed.join(starts, [*by, "__range"])
    joined = joined.withColumns({out: F.col(f"__w_{out}") + F.col(f"__s_{out}") for out in totals})
    return joined.drop("__range", *[f"__w_{o}" for o in totals], *[f"__s_{o}" for o in totals])


def ordered_codes(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """0-based position of each distinct value in ascending order, per group."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    return running_totals(ones, value, {out: "__one"}, by).withColumn(out, F.col(out) - 1).drop("__one")
