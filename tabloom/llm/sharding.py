"""Operator 9, sharding by balanced label propagation (law: `bytes`).

Documents with equal texts are linked. Every document starts with a hashed shard. Documents
of a group are alike, so a group is held as cells (group, shard, rows). In each round a cell
asks to join the shard where its group has most bytes; requests are taken in a hashed order
while the shard's quota of linked bytes lasts, a large cell in part. Rounds end when no row
moves. Documents of shards beyond an equal share leave again, and they and the unlinked
documents fill what each shard lacks: the larger ones first, the smaller ones to even it out.

Every step is a Spark join or a distributed prefix sum; the driver sees one number a round and
a row a shard. A group larger than a share is split over shards, by ranks of hash buckets.

Defined results: a null text has 0 bytes and size 1; rows equal in id and text are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.shared import prefix_sums, small_side, stored, text_of
from tabloom.session import discard

SHARDS = 8
SLACK = 1.05
SEED = 29


def _cells(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """(grp, shard, size, rows) of the groups that hold more than one row."""
    start = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(shards)).cast("int")
    counted = docs.groupBy("grp", start.alias("shard")).agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    rows = F.sum("rows").over(Window.partitionBy("grp"))
    return counted.withColumn("all", rows).where("all > 1").drop("all")


def _round(cells: DataFrame, quota: float, shards: int) -> tuple[DataFrame, int]:
    """One round of moves: the cells after it, and how many rows moved."""
    loads = cells.groupBy("shard").agg(F.sum(F.col("rows") * F.col("size")).alias("load"))
    every = cells.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = every.join(loads, "shard", "left").select(
        F.col("shard").alias("wish"), F.greatest(F.lit(0), F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room")
    )
    best = Window.partitionBy("grp").orderBy(F.desc("rows"), F.xxhash64("grp", "shard"))
    wishes = cells.withColumn("wish", F.first("shard").over(best)).where("wish != shard")
    wishes = stored(wishes, "wishes")
    taken = prefix_sums(wishes, "wish", ["grp", "shard"], F.col("rows") * F.col("size"), "before")
    fits = F.floor((F.col("room") - F.col("before")) / F.col("size"))
    moves = taken.join(F.broadcast(room), "wish").withColumn("n", F.greatest(F.lit(0), F.least("rows", fits)))
    moves = stored(moves.where("n > 0").select("grp", "shard", "wish", "size", "n"), "moves")
    moved = moves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    discard(wishes)
    if not moved:
        return cells, 0
    change = (
        cells.select("grp", "shard", "size", "rows")
        .unionAll(moves.select("grp", "shard", "size", -F.col("n")))
        .unionAll(moves.select("grp", "wish", "size", "n"))
    )
    after = change.groupBy("grp", "shard").agg(F.first("size").alias("size"), F.sum("rows").alias("rows"))
    return stored(after.where("rows > 0"), "cells"), moved


def propagate(cells: DataFrame, quota: float, shards: int = SHARDS) -> DataFrame:
    """Rounds until nothing moves. A cell only joins a larger one, so the rounds end."""
    while True:
        after, moved = _round(cells, quota, shards)
        if not moved:
            return after
        discard(cells)
        cells = after


def _deal(pool: DataFrame, need: DataFrame) -> DataFrame:
    """Cut the pool, in hashed order, into stretches in proportion to what each shard needs."""
    total = pool.agg(F.sum("size").alias("n")).first()["n"] or 0
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("need").over(Window.partitionBy())
    cuts = need.withColumn("cut", F.when(whole > 0, F.lit(total) * F.sum("need").over(upto) / whole).otherwise(F.lit(0)))
    cuts = [(r["shard"], float(r["cut"])) for r in cuts.orderBy("shard").collect()]  # a row a shard
    placed = prefix_sums(pool.withColumn("_all", F.lit(0)), "_all", ["doc_id", "grp"], F.col("size"), "before")
    middle = F.col("before") + F.col("size") / 2
    shard = F.lit(max(cuts, key=lambda c: c[1])[0])
    for number, cut in reversed(cuts):
        shard = F.when(middle < F.lit(cut), F.lit(number)).otherwise(shard)
    return placed.select("doc_id", "size", "crc", "grp", shard.alias("shard"))


def _loads(df: DataFrame, shards: int) -> DataFrame:
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(df.groupBy("shard").agg(F.sum("size").alias("load")), "shard", "left").na.fill(0, ["load"])


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, seed: int = SEED) -> DataFrame:
    """doc_id, size, crc, grp, shard for each row of docs (doc_id, size, crc, grp; stored)."""
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    share = total / shards
    cells = propagate(stored(_cells(docs, shards, seed), "cells"), share * slack, shards)

    # The rows of a group take its cells in turn, by their rank in the group.
    upto = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    turns = cells.withColumn("upto", F.sum("rows").over(upto)).groupBy("grp")
    turns = stored(turns.agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("turns")), "turns")
    marked = stored(docs.join(small_side(turns), "grp", "left"), "marked")
    linked = marked.where("turns is not null")
    ranked = prefix_sums(linked, "grp", ["doc_id"], F.lit(1), "rank")
    place = F.element_at(F.filter("turns", lambda t: t["upto"] > F.col("rank")), 1)["shard"]
    linked = stored(ranked.select("doc_id", "size", "crc", "grp", place.alias("shard")), "linked")

    # Rows beyond an equal share leave their shard.
    placed = prefix_sums(linked, "shard", ["grp", "doc_id"], F.col("size"), "before")
    stays = F.col("before") + F.col("size") <= F.lit(share)
    placed = stored(placed.withColumn("stays", stays), "placed")
    columns = ["doc_id", "size", "crc", "grp"]
    settled = placed.where("stays").select(*columns, "shard")
    pool = marked.where("turns is null").select(*columns).unionByName(placed.where("not stays").select(*columns))
    pool = stored(pool, "pool")
    middle = pool.agg(F.percentile_approx("size", 0.5).alias("m")).first()["m"] or 0
    for part in (pool.where(F.col("size") > middle), pool.where(F.col("size") <= middle)):
        if part.isEmpty():
            continue
        # The larger documents fill to the share of what can be known now, the smaller ones the rest.
        load = _loads(settled, shards)
        size = part.agg(F.sum("size").alias("n")).first()["n"]
        now = load.agg(F.sum("load").alias("n")).first()["n"] + size
        need = load.select("shard", F.greatest(F.lit(0), F.lit(now / shards) - F.col("load")).alias("need"))
        settled = stored(settled.unionByName(_deal(part, need)), "settled")
    return settled


def shard_documents(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    raw = F.encode(text_of(), "UTF-8")
    slim = docs.select(
        "doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"),
        F.md5(raw).alias("grp"),
    )
    placed = assign(stored(slim, "sized"), shards, **options)
    placed = prefix_sums(placed, "shard", ["doc_id", "grp"], F.lit(1), "slot")
    return placed.select(
        "doc_id", "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
