"""Exact ranks and rank cut-offs without sorting a whole group in one task.

Splits, folds and samples all ask for "the first r rows of each group in a given
order". A window per group would pull a dominant class into a single task, so the
row at rank r is located by counting: a histogram of the order value (partially
aggregated on the map side) names the bucket that holds the rank, and only the rows
of that bucket are ranked. Everything else is then a filter on the cut-off, with no
shuffle of the data rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_SPACE, hash32, quoted
from ..session import materialize, rows_if_small

BUCKETS = 1 << 16
RANKED_ROWS = 4_000_000

ORDER, TIE = "__order", "__tie"


def with_hash_order(df: DataFrame, key: str, *salt: Column) -> DataFrame:
    """Order rows by the seeded hash of the key; equal hashes by the key itself."""
    order = hash32(*salt, F.col(quoted(key)))
    return df.withColumns({ORDER: order, TIE: F.col(quoted(key))})


def with_key_order(df: DataFrame, key: str) -> DataFrame:
    """Order rows by an integer key."""
    return df.withColumns({ORDER: F.col(quoted(key)).cast("bigint"), TIE: F.col(quoted(key))})


def rank_cutoffs(
    ordered: DataFrame, by: Sequence[str], ranks_of: Callable[[DataFrame], DataFrame], span=(0, HASH_SPACE)
) -> DataFrame:
    """The order position of wanted ranks per group.

    `ranks_of` turns the group sizes (by..., n) into the wanted (by..., cut, rank). The
    result is (by..., cut, cut_order, cut_tie): a row is among the first `rank` rows of
    its group exactly if (order, tie) <= (cut_order, cut_tie). Ranks start at 1; ranks of
    0 or beyond the group are absent from the result. `span` is the half-open range of
    order values; None looks it up. Two scans of the order columns in all: group sizes
    come from the same histogram.
    """
    by = list(by)
    slim = ordered.select(*map(quoted, by), ORDER, TIE)
    if span is None:
        low, high = slim.agg(F.min(ORDER), F.max(ORDER)).first()
        span = (low, high + 1) if low is not None else (0, 1)
    origin, step = span[0], 1
    while step * BUCKETS < span[1] - span[0]:
        step *= 2

    counts = materialize(_histogram(slim, by, origin, step), "histogram")
    ranks = ranks_of(counts.groupBy(*map(quoted, by)).agg(F.sum("__n").alias("n")))
    wanted, largest = _checked(_locate(counts, by, ranks))
    while step > 1 and largest > RANKED_ROWS:
        inside = _rows_in_bucket(slim, wanted, by, origin, step)
        step = max(1, step // 4096)
        ranks = wanted.select(*map(quoted, by), "cut", "rank")
        wanted, largest = _checked(_locate(_histogram(inside, [*by, "cut"], origin, step), [*by, "cut"], ranks))

    place = Window.partitionBy(*map(quoted, by), "cut").orderBy(ORDER, TIE)
    return (
        _rows_in_bucket(slim, wanted, by, origin, step)
        .withColumn("__place", F.row_number().over(place))
        .where(F.col("__place") == F.col("rank"))
        .select(*map(quoted, by), "cut", F.col(ORDER).alias("cut_order"), F.col(TIE).alias("cut_tie"))
    )


def _checked(wanted: DataFrame) -> tuple[DataFrame, int]:
    """The located ranks as a broadcast side if they are few, and their fullest bucket."""
    rows = rows_if_small(wanted)
    if rows is None:
        held = materialize(wanted, "wanted")
        return held, held.agg(F.max("__rows")).first()[0]
    local = wanted.sparkSession.createDataFrame(rows, wanted.schema)
    return F.broadcast(local), max((r["__rows"] for r in rows), default=0)


def _bucket(origin: int, step: int) -> Column:
    return F.expr(f"({ORDER} - {origin}L) div {step}L")


def _histogram(rows: DataFrame, by: list[str], origin: int, step: int) -> DataFrame:
    return (
        rows.withColumn("__bucket", _bucket(origin, step))
        .groupBy(*map(quoted, by), "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def _locate(counts: DataFrame, by: list[str], ranks: DataFrame) -> DataFrame:
    """Bucket of each rank, with the rank left over inside that bucket."""
    running = Window.partitionBy(*[quoted(b) for b in by] or [F.lit(0)]).orderBy("__bucket")
    through = counts.withColumn("__through", F.sum("__n").over(running))
    if by:
        joined = through.join(ranks, by)
    else:
        wants = [F.struct(F.lit(r["cut"]).alias("cut"), F.lit(r["rank"]).alias("rank")) for r in ranks.collect()]
        if not wants:
            wants = [F.struct(F.lit(0).alias("cut"), F.lit(0).cast("bigint").alias("rank"))]
        joined = through.withColumn("__want", F.explode(F.array(*wants))).select("*", "__want.*").drop("__want")
    before = F.col("__through") - F.col("__n")
    return joined.where((F.col("rank") <= F.col("__through")) & (F.col("rank") > before)).select(
        *map(quoted, dict.fromkeys([*by, "cut"])),
        (F.col("rank") - before).cast("bigint").alias("rank"),
        "__bucket",
        F.col("__n").alias("__rows"),
    )


def _rows_in_bucket(slim: DataFrame, wanted: DataFrame, by: list[str], origin: int, step: int) -> DataFrame:
    return slim.withColumn("__bucket", _bucket(origin, step)).join(
        wanted.drop("__rows"), [*by, "__bucket"]
    ).drop("__bucket")


def cut_index(ordered: DataFrame, cutoffs: DataFrame, by: Sequence[str], out: str, absent: int = 0) -> DataFrame:
    """Number of cut-offs of its group that lie strictly before each row.

    With one cut-off the value is 0 inside the first `rank` rows and 1 beyond; with
    k-1 cut-offs it is the block number 0..k-1. A group has a handful of cut-offs; the
    rows of a group without any get `absent`.
    """
    by = list(by)
    if by:
        rows = rows_if_small(cutoffs)
        held = materialize(cutoffs, "cutoffs") if rows is None else cutoffs.sparkSession.createDataFrame(rows, cutoffs.schema)
        edges = held.groupBy(*map(quoted, by)).agg(
            F.sort_array(F.collect_list(F.struct("cut_order", "cut_tie"))).alias("__edges")
        )
        joined = ordered.join(edges if rows is None else F.broadcast(edges), by, "left")
    else:
        found = cutoffs.collect()
        if not found:
            return ordered.withColumn(out, F.lit(absent)).drop(ORDER, TIE)
        pairs = [F.struct(F.lit(e["cut_order"]).alias("cut_order"), F.lit(e["cut_tie"]).alias("cut_tie")) for e in found]
        joined = ordered.withColumn("__edges", F.array(*pairs))
    beyond = f"size(filter(__edges, e -> e.cut_order < {ORDER} or (e.cut_order = {ORDER} and e.cut_tie < {TIE})))"
    index = F.when(F.col("__edges").isNull(), F.lit(absent)).otherwise(F.expr(beyond))
    return joined.withColumn(out, index.cast("int")).drop("__edges", ORDER, TIE)


def dense_ordinals(ordered: DataFrame, by: Sequence[str], out: str, buckets: int = 4096) -> DataFrame:
    """Position 0..n-1 of every row inside its group in hash order.

    Rows are windowed per (group, hash range); the start of each range comes from the
    aggregated counts, so a dominant group still spreads over all tasks.
    """
    by = [*by]
    width = HASH_SPACE // buckets
    bucketed = ordered.withColumn("__bucket", F.expr(f"{ORDER} div {width}"))
    keys = [*map(quoted, by), "__bucket"]
    before = Window.partitionBy(*map(quoted, by)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ORDER, TIE)) - 1
    ranked = bucketed.withColumn("__place", place)
    return (
        ranked.join(starts, [*by, "__bucket"])
        .withColumn(out, (F.col("__start") + F.col("__place")).cast("bigint"))
        .drop("__bucket", "__start", "__place", ORDER, TIE)
    )
