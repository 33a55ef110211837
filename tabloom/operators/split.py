"""Holdouts, folds and learning-curve prefixes as filters on rank cut-offs."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import quoted, u01
from ..session import small_table
from .ranking import cut_index, rank_cutoffs, with_hash_order, with_key_order

# Holdout share and learning-curve steps.
TEST_SHARE = 0.3
CURVE_STEPS = (0.1, 0.325, 0.55, 0.775, 1.0)


def _total(counts: DataFrame) -> int:
    return counts.agg(F.sum("n")).first()[0] or 0


def _listed(counts: DataFrame, ends: list[tuple[int, int]]) -> DataFrame:
    return counts.sparkSession.createDataFrame([e for e in ends if e[1] > 0], "cut int, rank long")


def train_quotas(counts: DataFrame, label: str, test_share: float) -> DataFrame:
    """Train rows per class: proportional shares, left-over rows by largest remainder."""
    total = _total(counts)
    n_train = total - ceil(test_share * total - 1e-9)
    share = F.col("n") * n_train / F.lit(total)
    split = counts.withColumn("base", F.floor(share)).withColumn("rest", F.round(share - F.col("base"), 9))
    order = Window.orderBy(F.col("rest").desc(), F.col(quoted(label)))
    spare = F.lit(n_train) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    placed = split.withColumn("spare", spare).withColumn("place", F.row_number().over(order))
    extra = (F.col("place") <= F.col("spare")).cast("bigint")
    return placed.select(quoted(label), F.lit(0).alias("cut"), (F.col("base") + extra).cast("bigint").alias("rank"))


def stratified_holdout(df: DataFrame, label: str, key: str, test_share: float = TEST_SHARE, exact: bool = True) -> DataFrame:
    """Add `is_test`; every class keeps its share of the whole table.

    `exact=False` keeps the shares only in expectation and needs no counting pass.
    """
    if not exact:
        return df.withColumn("is_test", u01(key) < test_share)
    ordered = with_hash_order(df, key)
    cuts = rank_cutoffs(ordered, [label], lambda counts: train_quotas(counts, label, test_share))
    placed = cut_index(ordered, cuts, [label], "__block", absent=1)
    return placed.withColumn("is_test", F.col("__block") > 0).drop("__block")


def random_holdout(df: DataFrame, key: str, test_share: float = TEST_SHARE, exact: bool = True) -> DataFrame:
    """Add `is_test` for a share of all rows."""
    if not exact:
        return df.withColumn("is_test", u01(key) < test_share)

    def quota(counts: DataFrame) -> DataFrame:
        total = _total(counts)
        return _listed(counts, [(0, total - ceil(test_share * total - 1e-9))])

    ordered = with_hash_order(df, key)
    placed = cut_index(ordered, rank_cutoffs(ordered, [], quota), [], "__block", absent=1)
    return placed.withColumn("is_test", F.col("__block") > 0).drop("__block")


def _even_ends(total: int, k: int) -> list[tuple[int, int]]:
    """Ends of the first k-1 of k blocks; the first total mod k blocks hold one row more."""
    return [(i, (i + 1) * (total // k) + min(i + 1, total % k)) for i in range(k - 1)]


def random_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """k blocks of the hash order."""
    ordered = with_hash_order(df, key)
    cuts = rank_cutoffs(ordered, [], lambda counts: _listed(counts, _even_ends(_total(counts), k)))
    return cut_index(ordered, cuts, [], out)


def fold_quotas(counts: DataFrame, label: str, k: int) -> DataFrame:
    """Cumulative rows per class and fold so that fold sizes differ by at most one.

    Classes are laid end to end in label order and dealt to the folds in turn.
    """
    before = Window.orderBy(quoted(label)).rowsBetween(Window.unboundedPreceding, -1)
    laid = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    laid = laid.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    dealt = F.expr(f"(start + n - 1 - cut + {k}) div {k} - (start - 1 - cut + {k}) div {k}")
    through = Window.partitionBy(quoted(label)).orderBy("cut")
    return (
        laid.withColumn("rows", dealt)
        .withColumn("rank", F.sum("rows").over(through).cast("bigint"))
        .where((F.col("cut") < k - 1))
        .select(quoted(label), "cut", "rank")
    )


def stratified_folds(df: DataFrame, label: str, key: str, k: int, out: str = "fold") -> DataFrame:
    """k folds with the same class shares. A class may skip leading folds if it is small."""
    ordered = with_hash_order(df, key)
    skipped: list[DataFrame] = []

    def quotas(counts: DataFrame) -> DataFrame:
        ranks = small_table(fold_quotas(counts, label, k))
        skipped.append(ranks.where("rank = 0").groupBy(quoted(label)).agg(F.count(F.lit(1)).alias("__skipped")))
        return ranks.where("rank > 0")

    placed = cut_index(ordered, rank_cutoffs(ordered, [label], quotas), [label], out)
    # A rank of 0 has no row to cut at, so the empty leading folds are added back.
    if skipped[0].limit(1).count():
        placed = placed.join(skipped[0], label, "left")
        placed = placed.withColumn(out, F.col(out) + F.coalesce("__skipped", F.lit(0)).cast("int")).drop("__skipped")
    return placed


def contiguous_folds(df: DataFrame, key: str, k: int, label: str | None = None, out: str = "fold") -> DataFrame:
    """Unshuffled folds in key order, inside each class if a label is given."""
    by = [label] if label else []

    def ends(counts: DataFrame) -> DataFrame:
        if not label:
            return _listed(counts, _even_ends(_total(counts), k))
        rank = F.expr(f"(cut + 1) * (n div {k}) + least(cut + 1, n % {k})")
        every = counts.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(k - 2))))
        return every.select(quoted(label), "cut", rank.cast("bigint").alias("rank")).where("rank > 0")

    ordered = with_key_order(df, key)
    return cut_index(ordered, rank_cutoffs(ordered, by, ends, span=None), by, out)


def learning_steps(
    df: DataFrame, key: str, steps: tuple[float, ...] = CURVE_STEPS, out: str = "step", hashed: bool = False
) -> DataFrame:
    """First learning-curve step (0-based) whose prefix holds the row.

    Prefixes follow an integer key, or the hash order for rows without one.
    """
    empty: list[int] = []

    def ends(counts: DataFrame) -> DataFrame:
        total = _total(counts)
        found = [(i, int(f * total)) for i, f in enumerate(steps[:-1])]
        empty.append(sum(1 for _, rank in found if rank == 0))
        return _listed(counts, found)

    if hashed:
        ordered = with_hash_order(df, key, F.lit("curve"))
        cuts = rank_cutoffs(ordered, [], ends)
    else:
        ordered = with_key_order(df, key)
        cuts = rank_cutoffs(ordered, [], ends, span=None)
    placed = cut_index(ordered, cuts, [], out)
    return placed.withColumn(out, (F.col(out) + empty[0]).cast("int"))
