"""Queries for splits, folds, resampling and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance, neighbors, split
from .fixtures import FX_CLASS_SQL, FX_SQL, fx, fx_class, hash_sql, holdout_sql, random_holdout_sql, table, u01_sql

KEY = "o_orderkey"


def split_stratified(spark, sf_dir):
    return split.stratified_holdout(fx_class(spark, sf_dir), "level", KEY).select(KEY, "level", "is_test")


def split_random(spark, sf_dir):
    return split.random_holdout(fx(spark, sf_dir), KEY).select(KEY, "is_test")


def folds_stratified(spark, sf_dir):
    return split.stratified_folds(table(spark, sf_dir, "orders"), "o_orderstatus", KEY, 5).select(KEY, "o_orderstatus", "fold")


FOLDS_STRATIFIED_SQL = f"""with c as (select o_orderstatus as lab, count(*) as n from orders group by 1),
s as (select lab, n, coalesce(sum(n) over (order by lab rows between unbounded preceding and 1 preceding),0)::bigint as start from c),
d as (select lab, cut, (start+n-1-cut+5)//5 - (start-1-cut+5)//5 as m from s, range(5) r(cut)),
e as (select lab, cut, sum(m) over (partition by lab order by cut) as upto from d),
r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by {hash_sql(KEY)}, o_orderkey) as rn from orders)
select o_orderkey, o_orderstatus, (select count(*) from e where e.lab=r.o_orderstatus and e.upto<r.rn)::int as fold from r"""


def folds_random(spark, sf_dir):
    return split.random_folds(table(spark, sf_dir, "orders"), KEY, 5).select(KEY, "fold")


# Blocks of a random order: the first n mod k blocks are one row longer.
FOLDS_RANDOM_SQL = f"""with r as (select o_orderkey, row_number() over (order by {hash_sql(KEY)}, o_orderkey) - 1 as p, count(*) over () as n from orders)
select o_orderkey, (case when p < (n%5)*(n//5+1) then p//(n//5+1) else (n%5) + (p-(n%5)*(n//5+1))//(n//5) end)::int as fold from r"""


def folds_contiguous(spark, sf_dir):
    return split.contiguous_folds(table(spark, sf_dir, "orders"), KEY, 5, "o_orderstatus").select(KEY, "o_orderstatus", "fold")


FOLDS_CONTIGUOUS_SQL = "select o_orderkey, o_orderstatus, (ntile(5) over (partition by o_orderstatus order by o_orderkey)-1)::int as fold from orders"


def learning_prefixes(spark, sf_dir):
    return split.learning_steps(table(spark, sf_dir, "orders"), KEY).select(KEY, "step")


LEARNING_PREFIXES_SQL = """with r as (select o_orderkey, row_number() over (order by o_orderkey) as rn, count(*) over () as n from orders)
select o_orderkey, (cast(rn>floor(0.1::double*n) as int)+cast(rn>floor(0.325::double*n) as int)+cast(rn>floor(0.55::double*n) as int)
  +cast(rn>floor(0.775::double*n) as int))::int as step from r"""


def undersample(spark, sf_dir):
    return balance.undersample(fx_class(spark, sf_dir), "high", KEY).select(KEY, "high")


UNDERSAMPLE_SQL = f"""with {FX_CLASS_SQL}, r as (select o_orderkey, high, row_number() over (partition by high order by {hash_sql(KEY)}, o_orderkey) as rn from fxc)
select o_orderkey, high from r where rn <= (select min(n) from (select count(*) as n from fxc group by high))"""


def resample_plan(spark, sf_dir):
    data = fx_class(spark, sf_dir).withColumn("rare", (F.col("y") > 7.9).cast("int"))
    rows = [
        balance.resample_plan(data, t).select(F.lit(t).alias("target"), "band", "step") for t in ("level", "high", "rare")
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


RESAMPLE_PLAN_SQL = f"""with {FX_CLASS_SQL}, n as (
 select 'level' as target, count(*) as n from fxc group by level union all
 select 'high', count(*) from fxc group by high union all
 select 'rare', count(*) from fxc group by y>7.9),
e as (select target, max(n)/min(n)::double as ir from n group by 1)
select target, case when ir<=3 then 'mild' when ir<=20 then 'moderate' else 'none' end as band,
  case when ir<=3 then 'undersample' when ir<=20 then 'smote_tomek' else 'none' end as step from e"""


def knn_query(p: float):
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "embeddings")
        return neighbors.knn_join(e, e, 5, p, "vec_id", "embedding", exclude_self=True).select(
            "query", "neighbor", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank")
        )

    return run


def _distance(p: int) -> str:
    pairs = "list_transform(list_zip(a.v,b.v), lambda x: abs(x[1]-x[2]))"
    if p == 1:
        return f"list_sum({pairs})"
    if p == 2:
        return f"sqrt(list_sum(list_transform({pairs}, lambda g: g*g)))"
    return f"pow(list_sum(list_transform({pairs}, lambda g: g*g*g)), 1.0::double/3)"


VECTORS_SQL = "v as (select vec_id, label, embedding::double[] as v from embeddings)"


def _knn_sql(p: int, k: int) -> str:
    return f"""with {VECTORS_SQL},
d as (select a.vec_id as query, b.vec_id as neighbor, round({_distance(p)},9) as d from v a join v b on a.vec_id<>b.vec_id),
r as (select *, row_number() over (partition by query order by d, neighbor) as rank from d)
select query, neighbor, round(d,6) as distance, rank from r where rank<={k}"""


def tomek_links(spark, sf_dir):
    return balance.tomek_links(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


NEAREST_SQL = f"""{VECTORS_SQL},
d as (select a.vec_id as q, b.vec_id as n, round({_distance(2)},9) as d, a.label as la, b.label as lb from v a join v b on a.vec_id<>b.vec_id),
nn as (select * from d qualify row_number() over (partition by q order by d, n)=1),
links as (select x.q as a, x.n as b from nn x join nn y on x.n=y.q and y.n=x.q where x.la<>x.lb and x.q<x.n)"""


def tomek_removed(spark, sf_dir):
    return balance.remove_tomek(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label")


def _smote_input(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("rare"))


def smote_synthetic(spark, sf_dir):
    rows = balance.smote(_smote_input(spark, sf_dir), "rare", "vec_id", "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "rare", "draw", "base", "neighbor", F.round("gap", 9).alias("gap"),
        F.round(F.col("embedding")[0], 6).alias("first_value"), F.round(total, 6).alias("total"),
    )


SMOTE_SQL = f"""with w as (select vec_id, cast(label=0 as int) as rare, embedding::double[] as v from embeddings),
c as (select rare, count(*) as n from w group by 1),
need as (select rare, n, (select max(n) from c)-n as m from c where n<(select max(n) from c)),
draws as (select rare, n, unnest(range(m)) as draw from need),
picks as (select rare, draw, floor({u01_sql('rare','draw',"'base'")}*n)::bigint as ordinal,
   floor({u01_sql('rare','draw',"'neighbor'")}*5)::int+1 as rank, {u01_sql('rare','draw',"'gap'")} as gap from draws),
o as (select rare, vec_id, v, row_number() over (partition by rare order by {hash_sql('vec_id')}, vec_id)-1 as ordinal from w),
d as (select a.vec_id as q, b.vec_id as n, round({_distance(2)},9) as d from w a join w b on a.rare=b.rare and a.vec_id<>b.vec_id
   where a.rare in (select rare from need)),
nn as (select q, n, row_number() over (partition by q order by d, n) as rank from d),
s as (select p.rare, p.draw, o.vec_id as base, nn.n as neighbor, p.gap, o.v as va, w.v as vb
  from picks p join o on p.rare=o.rare and p.ordinal=o.ordinal join nn on nn.q=o.vec_id and nn.rank=p.rank join w on w.vec_id=nn.n)
select rare, draw, base, neighbor, round(gap,9) as gap, round(va[1]+gap*(vb[1]-va[1]),6) as first_value,
  round(list_sum(list_transform(list_zip(va,vb), lambda x: x[1]+gap*(x[2]-x[1]))),6) as total from s"""

QUERIES = {
    "split_stratified": (split_stratified, f"with {FX_CLASS_SQL}, {holdout_sql('fxc','level',KEY)} select o_orderkey, level, is_test from held"),
    "split_random": (split_random, f"with {FX_SQL}, {random_holdout_sql('fx',KEY)} select o_orderkey, is_test from held"),
    "folds_stratified": (folds_stratified, FOLDS_STRATIFIED_SQL),
    "folds_random": (folds_random, FOLDS_RANDOM_SQL),
    "folds_contiguous": (folds_contiguous, FOLDS_CONTIGUOUS_SQL),
    "learning_prefixes": (learning_prefixes, LEARNING_PREFIXES_SQL),
    "undersample": (undersample, UNDERSAMPLE_SQL),
    "resample_plan": (resample_plan, RESAMPLE_PLAN_SQL),
    "knn_join": (knn_query(2.0), _knn_sql(2, 5)),
    "knn_join_manhattan": (knn_query(1.0), _knn_sql(1, 5)),
    "knn_join_cubic": (knn_query(3.0), _knn_sql(3, 5)),
    "tomek_links": (tomek_links, f"with {NEAREST_SQL} select a, b from links"),
    "tomek_removed": (
        tomek_removed,
        f"with {NEAREST_SQL} select vec_id, label from embeddings where vec_id not in (select a from links union select b from links)",
    ),
    "smote_synthetic": (smote_synthetic, SMOTE_SQL),
}
