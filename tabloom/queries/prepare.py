"""Queries for sources, cleaning and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nulls import NULL_TOKENS, READER_NULL_TOKENS, null_tokens
from ..operators import clean, encode, profile
from ..session import materialize, scratch_path
from ..sources import tables
from .fixtures import DIRTY_SQL, FX_CLASS_SQL, FX_SQL, dirty_customer, fx, fx_class, holdout_sql, table
from ..operators.split import stratified_holdout


def _in(tokens) -> str:
    return "(" + ",".join("'" + t + "'" for t in tokens) + ")"


def scan_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    back = tables.read_table(spark, path)
    return back.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


def infer_column_types(spark, sf_dir):
    path = scratch_path(spark, "csv")
    dirty_customer(spark, sf_dir).write.option("header", True).csv(path)
    return tables.column_kinds(tables.read_text_columns(spark, path))


INFER_SQL = f"""with {DIRTY_SQL},
named as (
  select 'c_custkey' as "column", cast(c_custkey as varchar) as v from dirty union all
  select 'c_name', c_name from dirty union all
  select 'c_nationkey', cast(c_nationkey as varchar) from dirty union all
  select 'c_acctbal', cast(c_acctbal as varchar) from dirty union all
  select 'c_mktsegment', c_mktsegment from dirty)
select "column", case when bool_and(v is null or v in {_in(READER_NULL_TOKENS)} or try_cast(v as double) is not null)
  then 'numeric' else 'categorical' end as role from named group by 1"""


def null_tokens_default(spark, sf_dir):
    return null_tokens(dirty_customer(spark, sf_dir), READER_NULL_TOKENS)


def null_tokens_query(spark, sf_dir):
    return null_tokens(dirty_customer(spark, sf_dir))


def _blank_sql(tokens) -> str:
    return f"""with {DIRTY_SQL}
select c_custkey, c_name, c_nationkey, c_acctbal,
  case when c_mktsegment not in {_in(tokens)} then c_mktsegment end as c_mktsegment from dirty"""


def score_scan(spark, sf_dir):
    """A scoring file read with the types of a training table, extra columns dropped."""
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return tables.read_for_scoring(spark, path, {"c_custkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "categorical"})


def impute_mode(spark, sf_dir):
    blanked = null_tokens(dirty_customer(spark, sf_dir))
    fills = clean.fit_fills(blanked)
    return fills.apply(blanked).select("c_custkey", "c_mktsegment")


IMPUTE_MODE_SQL = f"""with {DIRTY_SQL},
b as (select c_custkey, case when c_mktsegment not in {_in(NULL_TOKENS)} then c_mktsegment end as s from dirty),
m as (select s from b where s is not null group by s order by count(*) desc, s limit 1)
select c_custkey, coalesce(b.s, m.s) as c_mktsegment from b, m"""


def impute_median(spark, sf_dir):
    blanked = null_tokens(dirty_customer(spark, sf_dir))
    return clean.fit_fills(blanked).apply(blanked).select("c_custkey", "c_acctbal")


IMPUTE_MEDIAN_SQL = f"""with {DIRTY_SQL}
select c_custkey, coalesce(c_acctbal, (select median(c_acctbal) from dirty)) as c_acctbal from dirty"""


DUP_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def dedup_rows(spark, sf_dir):
    return clean.drop_duplicates(table(spark, sf_dir, "lineitem").select(DUP_COLUMNS))


def clean_table(spark, sf_dir):
    """Tokens, imputation and duplicate removal together; customers told apart by balance, nation, segment."""
    cleaned, _ = clean.clean(dirty_customer(spark, sf_dir).select("c_nationkey", "c_acctbal", "c_mktsegment"))
    return cleaned


CLEAN_SQL = f"""with {DIRTY_SQL},
b as (select c_nationkey::double as c_nationkey, c_acctbal, case when c_mktsegment not in {_in(NULL_TOKENS)} then c_mktsegment end as s from dirty),
m as (select s from b where s is not null group by s order by count(*) desc, s limit 1)
select distinct c_nationkey, coalesce(c_acctbal, (select median(c_acctbal) from b)) as c_acctbal, coalesce(b.s, m.s) as c_mktsegment from b, m"""


def feature_projection(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    features, target = tables.features_and_target(c, "c_mktsegment")
    return c.select(*features, F.col(target).alias("target"))


def column_roles(spark, sf_dir):
    """Roles of the features of a file, as its values tell them."""
    path = scratch_path(spark, "csv")
    dirty_customer(spark, sf_dir).write.option("header", True).csv(path)
    roles = profile.column_roles(tables.read_table(spark, path), target="c_mktsegment")
    return spark.createDataFrame(roles, "column string, role string")


CONSTANTS = {"flat": 7.0, "tenth": 0.1}
CORR_COLUMNS = ["o_totalprice", "c_acctbal", "c_nationkey", "gross", *CONSTANTS]


def with_constants(df):
    """Constant columns on several partitions, where merged sums leave a tiny deviation."""
    return df.repartition(8, "o_orderkey").withColumns({c: F.lit(v) for c, v in CONSTANTS.items()})


def _corr_input(spark, sf_dir):
    return with_constants(fx(spark, sf_dir))


def corr_matrix(spark, sf_dir):
    pairs = profile.correlation_pairs(_corr_input(spark, sf_dir), CORR_COLUMNS)
    return pairs.select("a", "b", F.round("r", 6).alias("r"))


def _corr_sql(source: str) -> str:
    rows = []
    for i, a in enumerate(CORR_COLUMNS):
        for b in CORR_COLUMNS[: i + 1]:
            r = "max(null::double)" if a in CONSTANTS or b in CONSTANTS else f"round(corr({a},{b}),6)"
            rows.append(f"select '{a}' as a, '{b}' as b, {r} as r from {source}")
    return " union all ".join(rows)


WIDE = [f"v{k}" for k in range(45)]


def corr_matrix_wide(spark, sf_dir):
    """Many columns, each with its own missing values, one of them constant."""
    rows = fx(spark, sf_dir).repartition(8, "o_orderkey")
    wide = {}
    for k, name in enumerate(WIDE):
        value = F.lit(0.1) if k == 7 else F.col("y") * (k % 5) + F.col("o_totalprice") / 1e5 * (k % 3) + (F.col("o_orderkey") * (2 * k + 3)) % 101
        wide[name] = F.when(F.col("o_orderkey") % (k + 3) != 0, value.cast("double"))
    pairs = profile.correlation_pairs(rows.select([v.alias(n) for n, v in wide.items()]), WIDE)
    return pairs.select("a", "b", F.round("r", 6).alias("r"))


def _wide_corr_sql() -> str:
    columns, entries = [], []
    for k, name in enumerate(WIDE):
        value = "0.1::double" if k == 7 else f"y*{k % 5} + o_totalprice/100000.0::double*{k % 3} + (o_orderkey*{2 * k + 3})%101"
        columns.append(f"case when o_orderkey%{k + 3}<>0 then {value} end as {name}")
    for i, a in enumerate(WIDE):
        for j, b in enumerate(WIDE[: i + 1]):
            r = "null::double" if 7 in (i, j) else f"round(corr({a},{b}),6)"
            entries.append(f"struct_pack(a := '{a}', b := '{b}', r := {r})")
    return f"""with {FX_SQL}, w as (select {', '.join(columns)} from fx),
e as (select [{', '.join(entries)}] as l from w), u as (select unnest(l) as s from e)
select s.a as a, s.b as b, s.r as r from u"""


def _train_rows(spark, sf_dir):
    held = materialize(stratified_holdout(fx_class(spark, sf_dir), "level", "o_orderkey"), "held")
    return with_constants(held.where(~F.col("is_test")))


def corr_drop_list(spark, sf_dir):
    return profile.correlated_columns(profile.correlation_pairs(_train_rows(spark, sf_dir), CORR_COLUMNS))


TRAIN_SQL = f"""{FX_CLASS_SQL},
{holdout_sql('fxc', 'level', 'o_orderkey')},
train as (select * from held where not is_test)"""

CORR_DROP_SQL = f"""with {TRAIN_SQL}, pairs as ({_corr_sql('train')}),
pos(name, p) as (values {",".join(f"('{c}',{i})" for i, c in enumerate(CORR_COLUMNS))})
select distinct a as "column" from pairs join pos x on a=x.name join pos y on b=y.name where y.p<x.p and abs(r)>0.85"""


def drop_correlated(spark, sf_dir):
    """The columns that survive the filter, for train and test rows alike."""
    held = with_constants(materialize(stratified_holdout(fx_class(spark, sf_dir), "level", "o_orderkey"), "held"))
    train = held.where(~F.col("is_test"))
    dropped = [r[0] for r in profile.correlated_columns(profile.correlation_pairs(train, CORR_COLUMNS)).collect()]
    kept = [c for c in CORR_COLUMNS if c not in dropped]
    return held.select("o_orderkey", "is_test", *kept)


DROP_SQL = f"""with {TRAIN_SQL}
select o_orderkey, is_test, o_totalprice, c_acctbal, c_nationkey, 7.0::double as flat, 0.1::double as tenth from held"""


def class_counts(spark, sf_dir):
    return profile.class_counts(table(spark, sf_dir, "documents"), "source")


def imbalance_band(spark, sf_dir):
    data = fx_class(spark, sf_dir)
    severe = data.withColumn("rare", (F.col("y") > 7.9).cast("int"))
    out = None
    for target in ("level", "high", "rare", "o_orderstatus"):
        row = profile.imbalance(severe, target).select(
            F.lit(target).alias("target"), "majority", "minority", F.round("ratio", 6).alias("ratio"), "band"
        )
        out = row if out is None else out.unionByName(row)
    return out


def _band_sql() -> str:
    parts = []
    for target, expr in (
        ("level", "level"),
        ("high", "cast(high as varchar)"),
        ("rare", "cast(cast(y>7.9 as int) as varchar)"),
        ("o_orderstatus", "o_orderstatus"),
    ):
        parts.append(
            f"select '{target}' as target, max(n) as majority, min(n) as minority from "
            f"(select {expr} as v, count(*) as n from fxc group by 1)"
        )
    union = " union all ".join(parts)
    return f"""with {FX_CLASS_SQL}, e as ({union})
select target, majority, minority, round(majority/minority::double,6) as ratio,
  case when majority/minority::double<=3 then 'mild' when majority/minority::double<=20 then 'moderate' else 'none' end as band from e"""


TASK_TARGETS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_suppkey"]


def detect_task(spark, sf_dir):
    found = profile.detect_tasks(table(spark, sf_dir, "lineitem"), TASK_TARGETS)
    return spark.createDataFrame(found, "target string, task string, encode boolean")


def _task_sql() -> str:
    parts = []
    for t in TASK_TARGETS:
        if t in ("l_returnflag", "l_linestatus"):
            parts.append(f"select '{t}' as target, 'classification' as task, true as encode")
        else:
            parts.append(
                f"select '{t}', case when count(distinct {t})<20 then 'classification' else 'regression' end, false from lineitem"
            )
    return " union all ".join(parts)


def averaging_mode(spark, sf_dir):
    """The averaging of each classification target over the training rows."""
    rows = []
    for target in ("level", "o_orderstatus"):
        train = stratified_holdout(fx_class(spark, sf_dir), target, "o_orderkey").where(~F.col("is_test"))
        rows.append(
            train.agg(F.countDistinct(target).alias("n_classes")).select(
                F.lit(target).alias("target"),
                "n_classes",
                F.when(F.col("n_classes") > 2, "weighted").otherwise("binary").alias("average"),
            )
        )
    return rows[0].unionByName(rows[1])


AVERAGING_SQL = f"""with {FX_CLASS_SQL}, {holdout_sql('fxc','level','o_orderkey','h1')}, {holdout_sql('fxc','o_orderstatus','o_orderkey','h2')},
c as (select 'level' as target, count(distinct level) as n_classes from h1 where not is_test
 union all select 'o_orderstatus', count(distinct o_orderstatus) from h2 where not is_test)
select target, n_classes, case when n_classes>2 then 'weighted' else 'binary' end as average from c"""

ROUTED = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name"]


def encoder_routing(spark, sf_dir):
    return encode.routing(_train_rows(spark, sf_dir), ROUTED)


def _routing_sql() -> str:
    parts = " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_values from train" for c in ROUTED)
    return f"""with {TRAIN_SQL}, n as ({parts})
select "column", n_values, case when n_values>10 then 'OrdinalEncoder' else 'OneHotEncoder' end as encoder from n"""


def class_distribution(spark, sf_dir):
    from ..operators.curves import class_distribution as distribution

    return distribution(stratified_holdout(fx_class(spark, sf_dir), "level", "o_orderkey"), "level")


def fold_cap(spark, sf_dir):
    train = stratified_holdout(fx_class(spark, sf_dir), "high", "o_orderkey").where(~F.col("is_test"))
    return profile.class_counts(train, "high").agg(
        F.least(F.lit(5), F.min("n")).cast("bigint").alias("folds"), F.min("n").alias("smallest")
    )


QUERIES = {
    "scan_csv_roundtrip": (scan_csv_roundtrip, "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer"),
    "infer_column_types": (infer_column_types, INFER_SQL),
    "null_tokens_default": (null_tokens_default, _blank_sql(READER_NULL_TOKENS)),
    "null_tokens": (null_tokens_query, _blank_sql(NULL_TOKENS)),
    "score_scan": (score_scan, "select c_custkey::double as c_custkey, c_acctbal, c_mktsegment from customer"),
    "impute_mode": (impute_mode, IMPUTE_MODE_SQL),
    "impute_median": (impute_median, IMPUTE_MEDIAN_SQL),
    "dedup_rows": (dedup_rows, f"select distinct {','.join(DUP_COLUMNS)} from lineitem"),
    "clean_table": (clean_table, CLEAN_SQL),
    "feature_projection": (feature_projection, "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment as target from customer"),
    "column_roles": (column_roles, f"select * from ({INFER_SQL}) where \"column\" <> 'c_mktsegment'"),
    "corr_matrix": (corr_matrix, f"with {FX_SQL}, x as (select * from fx) {_corr_sql('x')}"),
    "corr_matrix_wide": (corr_matrix_wide, _wide_corr_sql()),
    "corr_drop_list": (corr_drop_list, CORR_DROP_SQL),
    "drop_correlated": (drop_correlated, DROP_SQL),
    "class_counts": (class_counts, 'select source as "class", count(*) as n from documents group by 1'),
    "imbalance_band": (imbalance_band, _band_sql()),
    "detect_task": (detect_task, _task_sql()),
    "averaging_mode": (averaging_mode, AVERAGING_SQL),
    "encoder_routing": (encoder_routing, _routing_sql()),
    "class_distribution": (class_distribution, f"with {TRAIN_SQL} select is_test, level, count(*) as n from held group by 1,2"),
    "fold_cap": (
        fold_cap,
        f"""with {FX_CLASS_SQL}, {holdout_sql('fxc','high','o_orderkey')}, c as (select high, count(*) as n from held where not is_test group by 1)
select least(5, min(n))::bigint as folds, min(n) as smallest from c""",
    ),
}
