"""The registered queries of this folder: name -> (callable, SQL for DuckDB or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import (
    bpe, embedding_dedup, exact_dedup, hard_negatives, kneser_ney, mixing, near_dedup, quality, secrets, sharding,
    substring_dedup, token_files, vectors, whitening,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.verdicts(documents(spark, sf_dir)).select(*base, "removed_words")


def op3_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(documents(spark, sf_dir))


def op5_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(documents(spark, sf_dir))


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir), width=4)


def op9_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(documents(spark, sf_dir))


def op11_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def mining_rows(rows: DataFrame) -> DataFrame:
    """The rows that op12 mines: moved labels, and entries as whole numbers."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.when(vectors.usable(F.col("embedding")), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))))
    return rows.select("vec_id", moved.alias("label"), whole.alias("vector"))


def op12_secondary_sort_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(mining_rows(embeddings(spark, sf_dir)), F.col("vec_id") % 100 == 0)


def op13_pigeonhole_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(embeddings(spark, sf_dir))


EXACT_DEDUP_SQL = """
select doc_id, max(doc_id) over copies as keep_id, count(*) over copies as group_size,
       doc_id = max(doc_id) over copies as kept, sha256(coalesce(text, '')) as text_sha256
from documents
window copies as (partition by coalesce(text, ''))
"""

HARD_NEGATIVES_SQL = """
with whole as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as alike,
           cast(list_inner_product(a.v, r.v) as bigint) as score
    from whole a join whole r on a.vec_id <> r.vec_id
    where a.vec_id % 100 = 0
), positives as (
    select * from scores where alike
    qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.other_id as positive_id,
       cast(row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) as integer) as rank,
       n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n
  on n.anchor_id = p.anchor_id and not n.alike and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""

NEAR_VECTORS_SQL = """
with recursive usable as (
    select vec_id, cast(embedding as double[]) as v from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b
      on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) as (
    select a, b from links
    union
    select r.a, l.b from reach r join links l on l.a = r.b
), least as (
    select a, min(b) as smallest from reach group by a
), counts as (
    select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(l.smallest, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(l.smallest, e.vec_id)) as kept
from embeddings e left join counts c on c.a = e.vec_id left join least l on l.a = e.vec_id
"""

QUERIES = {
    "op1_unit_dedup": (op1_unit_dedup, None),
    "op2_line_frequency": (op2_line_frequency, None),
    "op3_trigram_secrets": (op3_trigram_secrets, None),
    "op4_kneser_ney": (op4_kneser_ney, None),
    "op5_simple8b_tokens": (op5_simple8b_tokens, None),
    "op6_mixing": (op6_mixing, None),
    "op7_exact_dedup": (op7_exact_dedup, EXACT_DEDUP_SQL),
    "op8_hyperminhash": (op8_hyperminhash, None),
    "op9_label_sharding": (op9_label_sharding, None),
    "op10_piece_bpe": (op10_piece_bpe, None),
    "op11_chebyshev_whitening": (op11_chebyshev_whitening, None),
    "op12_secondary_sort_negatives": (op12_secondary_sort_negatives, HARD_NEGATIVES_SQL),
    "op13_pigeonhole_dedup": (op13_pigeonhole_dedup, NEAR_VECTORS_SQL),
}
