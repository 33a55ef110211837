"""Operator 7, exact dedup by progressive refinement: length, then prefix hash, then full hash.

Native: DataFrame functions only. Three passes narrow the candidates. Only rows whose length
occurs twice get a prefix hash, only rows whose (length, prefix) occurs twice have their full
content hashed, and only groups of equal digests are joined back. Counts are combined on the
map side, so a group that holds a third of all rows reaches the shuffle as one row per task.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id
stays (a null id is the smallest); rows equal in id and text are interchangeable and one of
them stays; an empty table gives an empty result; other columns are carried unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import small_side, stored, text_of

PREFIX_CHARS = 256


def _repeated(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The key values that occur more than once, as a stored table."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return stored(found.select(*keys, F.lit(True).alias("_again")), label)


def _narrow(rows: DataFrame, keys: list[str], label: str, new: str, value) -> DataFrame:
    """Add column `new`: `value` where the keys occur more than once, null elsewhere."""
    again = small_side(_repeated(rows.where(F.col(keys[-1]).isNotNull()), keys, label))
    return rows.join(again, keys, "left").withColumn(new, F.when(F.col("_again"), value)).drop("_again")


def refine(rows: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """`rows` (with `_text`) and `_full`: the digest of the whole text where a twin may exist."""
    text = F.col("_text")
    rows = rows.withColumn("_length", F.octet_length(text))
    rows = _narrow(rows, ["_length"], "lengths", "_prefix", F.xxhash64(F.substring(text, 1, prefix_chars)))
    return _narrow(rows, ["_length", "_prefix"], "prefixes", "_full", F.sha2(text, 256))


def groups_of(rows: DataFrame) -> DataFrame:
    """A stored row for each digest that occurs more than once: keep_id, group_size, ties.

    `ties` is the number of rows of the group that carry keep_id.
    """
    by_id = rows.where(F.col("_full").isNotNull()).groupBy("_full", "_id").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("_id"), F.col("n")))
    groups = by_id.groupBy("_full").agg(top.alias("top"), F.sum("n").alias("group_size"))
    return stored(
        groups.where("group_size > 1").select(
            "_full", F.col("top._id").alias("keep_id"), "group_size", F.col("top.n").alias("ties")
        ),
        "copies",
    )


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` with the group of their digest; rows without one are spread by id and length, not met in one task."""
    lone = F.concat_ws("-", F.lit(""), F.col("_id").cast("string"), F.col("_length").cast("string"))
    at = groups.withColumnRenamed("_full", "_at")
    return rows.withColumn("_at", F.coalesce("_full", lone)).join(small_side(at), "_at", "left").drop("_at")


def _rows_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").alias("_id"), text_of().alias("_text"), F.struct("*").alias("_row"))
    rows = refine(rows)
    return rows, groups_of(rows.drop("_row"))


def copy_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the digest of its text."""
    rows, groups = _rows_and_groups(docs)
    # A repeated row (same id, same text) is counted, so that one of the repeats stays.
    slim = rows.select("_id", "_length", "_full", F.sha2("_text", 256).alias("text_sha256"))
    counted = slim.groupBy("_id", "_length", "_full", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    counted = _with_groups(counted, groups)
    grouped = F.col("group_size").isNotNull()
    return counted.select(
        F.col("_id").alias("doc_id"),
        F.when(grouped, F.col("keep_id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("_id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("_stays"),
        "text_sha256",
        F.posexplode(F.expr("sequence(1L, n)")).alias("_nth", "_of"),
    ).select(
        "doc_id", "keep_id", "group_size", (F.col("_stays") & (F.col("_nth") == 0)).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    rows, groups = _rows_and_groups(docs)
    marked = _with_groups(rows, groups)
    stays = F.col("group_size").isNull() | F.col("_id").eqNullSafe(F.col("keep_id"))
    marked = marked.where(stays).select("_full", "_row", F.coalesce("ties", F.lit(1)).alias("ties"))
    single = marked.where("ties = 1").select("_row.*")
    repeated = marked.where("ties > 1").dropDuplicates(["_full"]).select("_row.*")
    return single.unionByName(repeated)
