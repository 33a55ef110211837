"""Operator 6, mixing sources to target weights, from fixed-length blocks.

Native: DataFrame functions only. The documents of a source, in a seeded hash order, form one
stream of words, which is cut into blocks of `block_words`. A source gets as many slots as its
target holds blocks. The slots of all sources, put through one seeded permutation and cut into
output shards of `shard_slots`, give each shard its counts of the sources: a multinomial draw
given that the sources' totals come out, so that the targets are met to a block. From its counts
a shard takes a run of slot numbers of each source. Slot number k of a source takes block
perm(k mod blocks) of pass k div blocks, where perm is a permutation of the block indices seeded
by source and pass; slots and blocks are joined by (source, index).

A permutation of n indices is a Feistel network of `ROUNDS` rounds on pairs of numbers below the
root of n (rounded up), walked on until it falls below n. Below 1,024 indices the walk always
ends; from there on one index stays outside with a probability below 2^-100.

A source with most of the rows is laid out in hash buckets, its slots are generated in chunks and
numbered inside shards, and the join key contains the block index, so no source meets in one task. The table of
sources is ranked in one task; it has a row for each distinct source.

Defined results: a null text has no words; a null source is a source of its own, ranked last;
a source without words has target 0; rows equal in id, source and text are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.shared import one_of_each, prefix_sums, small_side, stored, text_of

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 8_192
SEED = 11
SLOT_CHUNK = 16_384
PART_SLOTS = 131_072
ROUNDS = 4
#: A word with the white space before it.
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def source_table(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, src (its number), words and target: weight shares, capped, the excess reshared.

    In the order of 3 * words / weight the first sources are capped. `level` is the words per
    unit of weight if all before are capped; the largest one that a source can bear holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    most = F.col("words") * max_passes
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("words"))
        .withColumn("src", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("src") % len(weights) + 1))
        .withColumn("ratio", most / F.col("weight"))
    )
    whole = Window.partitionBy()
    order = Window.orderBy("ratio", "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("words").over(whole) - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(
        onwards
    )
    sources = sources.withColumn("level", level).withColumn("free", F.col("level") <= F.col("ratio"))
    settled = F.max(F.when(F.col("free"), F.col("level"))).over(whole)
    target = F.least(F.when(F.col("free"), settled * F.col("weight")).otherwise(most), most.cast("double"))
    return sources.select("source", "src", "words", target.cast("double").alias("target"))


def slot_counts(sources: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    """Blocks and slots of each source: whole passes over it and a rounded part of a pass."""
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(F.lit(0))
    blocks = F.ceil(F.col("words") / block_words)
    part = F.round((F.col("target") - passes * F.col("words")) / block_words).cast("long")
    slots = F.least(passes * blocks + F.least(part, blocks), blocks * max_passes)
    return sources.withColumn("blocks", blocks).withColumn("slots", F.coalesce(slots, F.lit(0)))


def permuted(index, n, key):
    """The place of `index` in the permutation of 0 to n - 1 that `key` seeds."""
    index, n = index.cast("long"), n.cast("long")
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    outside = side * side - n
    # A step leaves the range with a probability of at most 2 / sqrt(n).
    enough = F.ceil(F.lit(100.0) / (F.log2(side.cast("double")) - 1)).cast("long") + 1
    steps = F.when(n < 1_024, outside + 1).otherwise(F.least(outside + 1, enough))

    def round_of(pair, turn):
        mixed = F.pmod(F.xxhash64(key, turn, pair["right"]), side)
        return F.struct(pair["right"].alias("left"), ((pair["left"] + mixed) % side).alias("right"))

    def step(value):
        pair = F.struct(F.floor(value / side).cast("long").alias("left"), (value % side).alias("right"))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)), pair, round_of, lambda p: p["left"] * side + p["right"]
        )

    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), steps), F.lit(-1).cast("long"),
        lambda at, _: F.when((at >= 0) & (at < n), at).otherwise(step(F.when(at < 0, index).otherwise(at))),
    )


def drawn_places(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """Stored (src, blocks, shard, slot): every output slot of the mix and the source it is drawn for."""
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    earlier = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    from_ = F.coalesce(F.sum("slots").over(earlier), F.lit(0))
    chunks = sources.withColumn("from_", from_).where("slots > 0").select(
        "src", "blocks", "slots", "from_", F.explode(F.expr(f"sequence(0L, slots - 1, {SLOT_CHUNK}L)")).alias("first")
    )
    # A stated number of parts: chunks are small rows, and AQE would join them all into one task.
    chunks = chunks.repartition(max(1, total // PART_SLOTS), "src", "first")
    labels = chunks.select(
        "src", "blocks", "from_", F.explode(F.expr(f"sequence(first, least(first + {SLOT_CHUNK}, slots) - 1)")).alias("k")
    )
    place = permuted(F.col("from_") + F.col("k"), F.lit(max(total, 1)), F.lit(seed))
    placed = labels.select("src", "blocks", place.alias("place"))
    shard, slot = F.expr(f"place div {shard_slots}"), F.pmod("place", F.lit(shard_slots))
    return stored(placed.select("src", "blocks", shard.alias("shard"), slot.cast("int").alias("slot")), "places")


def shard_counts(places: DataFrame) -> DataFrame:
    """Stored (shard, src, n, first): the sources' counts of each shard, and where its run of slot numbers begins."""
    counts = places.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("n"))
    return stored(prefix_sums(stored(counts, "counts"), "src", ["shard"], F.col("n"), "first"), "runs")


def draw_slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The slots of the mix: shard, slot (its place there), src, k (its number in the source), pass and block."""
    places = drawn_places(sources, shard_slots, seed)
    runs = shard_counts(places)
    inside = F.row_number().over(Window.partitionBy("shard", "src").orderBy("slot")) - 1
    slots = places.withColumn("inside", inside).join(runs, ["shard", "src"])
    slots = slots.withColumn("k", F.col("first") + F.col("inside")).withColumn("pass", F.expr("k div blocks"))
    key = F.xxhash64(F.lit(seed + 1), "src", "pass")
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), key)
    return slots.select("shard", "slot", "src", "k", "pass", block.alias("block"))


def lay_out(docs: DataFrame, block_words: int, max_passes: int) -> tuple[DataFrame, DataFrame]:
    """(documents with src, size and start in their source's stream; the table of sources)."""
    size = F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = stored(
        docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text_of()).alias("digest")), "sized"
    )
    sources = stored(slot_counts(source_table(sized, max_passes=max_passes), block_words, max_passes), "sources")
    sides = small_side(sources.select(F.col("source").alias("_source"), "src", "words", "target"))
    numbered = sized.join(sides, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    laid = prefix_sums(stored(numbered, "numbered"), "src", ["doc_id", "digest", "size"], F.col("size"), "start")
    return stored(laid, "laid"), sources


def pieces_of(laid: DataFrame, block_words: int) -> DataFrame:
    """What each document gives to each block: src, block, start (names the document), at, n."""
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = laid.where("size > 0").select("src", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    opening = F.greatest(F.col("start"), F.col("block") * block_words)
    closing = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return pieces.select("src", "block", "start", (opening - F.col("start")).alias("at"), (closing - opening).alias("n"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per document: size, words of its source, target of its source and words taken."""
    laid, sources = lay_out(docs, block_words, max_passes)
    times = draw_slots(sources).groupBy("src", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        pieces_of(laid, block_words)
        .join(times.hint("merge"), ["src", "block"])  # exploded: its size is underestimated
        .groupBy("src", "start")
        .agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
        .withColumn("_some", F.lit(True))
    )
    rows = laid.withColumn("_some", F.col("size") > 0).join(taken, ["src", "start", "_some"], "left")
    return rows.select(
        "doc_id", "size", F.col("words").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


def _stretches(parts: str):
    """The contiguous stretches (first word, word after the last) of sorted parts (at, n)."""
    opens = F.filter(parts, lambda p, k: F.coalesce(F.get(parts, k - 1)["at"] + F.get(parts, k - 1)["n"] != p["at"], F.lit(True)))
    closes = F.filter(parts, lambda p, k: F.coalesce(F.get(parts, k + 1)["at"] != p["at"] + p["n"], F.lit(True)))
    first, last = F.transform(opens, lambda p: p["at"]), F.transform(closes, lambda p: p["at"] + p["n"])
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as blocks: shard, slot, source, words (the block's words in stream order).

    Slots of a shard are gapless from 0; the last block of a source may be shorter.
    """
    laid, sources = lay_out(docs, block_words, max_passes)
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "n")))
    cuts = pieces_of(laid, block_words).groupBy("src", "start").agg(parts.alias("parts"))
    named = laid.where("size > 0").join(cuts, ["src", "start"])
    named = named.select(F.col("doc_id").alias("_id"), "digest", F.col("source").alias("_source"), "src", "start", "parts")
    rows = docs.select(
        F.col("doc_id").alias("_id"), F.xxhash64(text_of()).alias("digest"), F.col("source").alias("_source"), text_of().alias("text")
    )
    # Rows equal in id, source and text are interchangeable: one text serves all their places.
    kind, same = ["_id", "digest", "_source"], F.lit(True)
    rows = one_of_each(rows, laid.selectExpr("doc_id as _id", "digest", "source as _source"), kind)
    for name in kind:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    joined = rows.alias("a").join(named.alias("b"), same).select("text", "src", "start", "parts")
    # The generator keeps the split of a text out of the lambda, which would repeat it.
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    split = joined.select("src", "start", "parts", F.explode(F.array(words)).alias("_words"))
    piece = lambda p: F.struct(
        p["block"].alias("block"), F.slice("_words", p["at"].cast("int") + 1, p["n"].cast("int")).alias("words")
    )
    each = split.select("src", "start", F.explode(F.transform("parts", piece)).alias("piece"))
    filled = each.groupBy("src", F.col("piece.block").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("start", "piece.words"))).alias("held")
    )
    blocks = filled.select("src", "block", F.flatten(F.transform("held", lambda h: h["words"])).alias("words"))
    names = small_side(sources.select("src", "source"))
    slots = draw_slots(sources, shard_slots).select("shard", "slot", "src", "block")
    return slots.join(blocks, ["src", "block"]).join(names, "src").select("shard", "slot", "source", "words")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself with the columns of `docs`: a row for each stretch that a pass takes.

    A pass that takes all blocks of a document gives its whole text; another one gives a row for
    each contiguous stretch of the blocks it takes, with the white space before its words. `n_chars`, where there is one,
    follows the text. Documents without words are never drawn.
    """
    laid, sources = lay_out(docs, block_words, max_passes)
    parts = (
        pieces_of(laid, block_words)
        .join(draw_slots(sources).select("src", "block", "pass").hint("merge"), ["src", "block"])
        .groupBy("src", "start", "pass")
        .agg(F.sum("n").alias("got"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("parts"))
    )
    cut = F.col("got") < F.col("size")
    stretch = lambda p: F.struct(p["first"].cast("int").alias("first"), p["last"].cast("int").alias("last"), cut.alias("cut"))
    drawn = (
        laid.where("size > 0").drop("words", "target").join(parts, ["src", "start"])
        .withColumn("_parts", F.transform(_stretches("parts"), stretch))
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("source").alias("_source"))
        .agg(F.flatten(F.collect_list("_parts")).alias("_parts"))
    )
    keys = ["_id", "_digest", "_source"]
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(
        F.struct(*others).alias("_row"), F.col("text").alias("_text"), F.col("doc_id").alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"), F.col("source").alias("_source"),
    )
    rows = one_of_each(rows, laid.selectExpr("doc_id as _id", "digest as _digest", "source as _source"), keys)
    same = (
        F.col("a._id").eqNullSafe(F.col("b._id"))
        & (F.col("a._digest") == F.col("b._digest"))
        & F.col("a._source").eqNullSafe(F.col("b._source"))
    )
    joined = rows.alias("a").join(drawn.alias("b"), same).select("a._row", "a._text", "b._parts")
    # A text is split into words once: the generator keeps the split out of the lambda, which would repeat it.
    words = F.when(F.exists("_parts", lambda p: p["cut"]), F.regexp_extract_all("_text", F.lit(SPACED_WORD), F.lit(0)))
    split = joined.select("_row", "_text", "_parts", F.explode(F.array(words)).alias("_words"))
    piece = lambda p: F.array_join(F.slice("_words", p["first"] + 1, p["last"] - p["first"]), "")
    texts = F.transform("_parts", lambda p: F.when(p["cut"], piece(p)).otherwise(F.col("_text")))
    out = split.select("_row", F.explode(texts).alias("_new"))
    columns = []
    for field in docs.columns:
        if field == "text":
            columns.append(F.col("_new").alias(field))
        elif field == "n_chars":
            columns.append(F.length("_new").cast(docs.schema[field].dataType).alias(field))
        else:
            columns.append(F.col("_row").getField(field).alias(field))
    return out.select(*columns)
