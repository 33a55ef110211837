"""Inputs of the registered queries: Spark tables and the same relations as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import u01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer, a derived copy of the price and a target y."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", 1.5).otherwise(0.0)
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
        "o_orderpriority",
        "c_acctbal",
        "c_nationkey",
        "c_mktsegment",
        "c_name",
        (F.col("o_totalprice") * 1.1 + 3.0).alias("gross"),
        (F.col("o_totalprice") / 100000.0 + F.col("c_acctbal") / 5000.0 + urgent + F.lit(0.5) * u01("o_orderkey")).alias("y"),
    )


def hash_sql(*key: str) -> str:
    parts = ",".join(f"cast({k} as varchar)" for k in key)
    return f"cast('0x'||substr(md5(concat_ws('|','42',{parts})),1,8) as bigint)"


def u01_sql(*key: str) -> str:
    return f"({hash_sql(*key)}/4294967296.0::double)"


FX_SQL = f"""fx as (
  select o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, c_acctbal, c_nationkey, c_mktsegment, c_name,
         o_totalprice*1.1::double+3.0::double as gross,
         o_totalprice/100000.0::double + c_acctbal/5000.0::double
           + case when o_orderpriority='1-URGENT' then 1.5::double else 0.0::double end
           + 0.5::double*{u01_sql('o_orderkey')} as y
  from orders join customer on o_custkey=c_custkey)"""


def fx_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx with a near-even text class and a 7:1 class."""
    return fx(spark, sf_dir).withColumns(
        {
            "level": F.when(F.col("y") > 4.0, "hi").otherwise("lo"),
            "high": (F.col("y") > 6.0).cast("int"),
        }
    )


FX_CLASS_SQL = f"""{FX_SQL},
fxc as (select *, case when y>4.0 then 'hi' else 'lo' end as level, cast(y>6.0 as int) as high from fx)"""


def holdout_sql(source: str, label: str, key: str, name: str = "held") -> str:
    """Stratified 70/30: train quota by largest remainder, first rows in hash order."""
    return f"""{name}_n as (select {label} as lab, count(*) as n from {source} group by 1),
{name}_t as (select sum(n)::bigint as total, (sum(n) - ceil(0.3*sum(n)-1e-9))::bigint as n_train from {name}_n),
{name}_s as (select lab, n, floor(n*n_train/total::double) as base,
   round(n*n_train/total::double - floor(n*n_train/total::double), 9) as rest, n_train from {name}_n, {name}_t),
{name}_q as (select lab, base + case when row_number() over (order by rest desc, lab)
   <= n_train - sum(base) over () then 1 else 0 end as quota from {name}_s),
{name} as (select s.*, row_number() over (partition by s.{label} order by {hash_sql('s.'+key)}, s.{key}) > q.quota as is_test
   from {source} s join {name}_q q on s.{label}=q.lab)"""


def random_holdout_sql(source: str, key: str, name: str = "held") -> str:
    return f"""{name} as (select s.*, row_number() over (order by {hash_sql('s.'+key)}, s.{key})
   > (select count(*)-ceil(0.3*count(*)-1e-9) from {source}) as is_test from {source} s)"""


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with missing balances and with texts that stand for missing segments."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    segment = (
        F.when(k % 11 == 0, "?")
        .when(k % 13 == 0, "NA")
        .when(k % 17 == 0, "--")
        .when(k % 19 == 0, "")
        .otherwise(F.col("c_mktsegment"))
    )
    return c.withColumns({"c_acctbal": F.when(k % 7 != 0, F.col("c_acctbal")), "c_mktsegment": segment})


DIRTY_SQL = """dirty as (
  select c_custkey, c_name, c_nationkey, case when c_custkey%7<>0 then c_acctbal end as c_acctbal,
         case when c_custkey%11=0 then '?' when c_custkey%13=0 then 'NA' when c_custkey%17=0 then '--'
              when c_custkey%19=0 then '' else c_mktsegment end as c_mktsegment
  from customer)"""


def scored_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fx row scored by its price alone."""
    score = F.col("o_totalprice") / 500000.0
    return fx(spark, sf_dir).select(
        "o_orderkey",
        (F.col("y") > 4.0).cast("double").alias("label"),
        score.alias("score"),
        (score > 0.5).cast("double").alias("prediction"),
    )


SCORED_BINARY_SQL = f"""{FX_SQL},
scored as (select o_orderkey, cast(y>4.0 as int)::double as label, o_totalprice/500000.0::double as score,
  cast(o_totalprice/500000.0::double>0.5 as int)::double as prediction from fx)"""


def scored_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class scores that lean to the true status, normalised to one."""
    orders = table(spark, sf_dir, "orders")
    truth = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    raw = [u01(F.col("o_orderkey") * 3 + c) + F.when(truth == c, 0.25).otherwise(0.0) for c in range(3)]
    rows = orders.select("o_orderkey", truth.cast("double").alias("label"), *[r.alias(f"s{c}") for c, r in enumerate(raw)])
    total = F.col("s0") + F.col("s1") + F.col("s2")
    scores = [F.round(F.col(f"s{c}") / total, 6) for c in range(3)]
    rows = rows.withColumn("scores", F.array(*scores))
    best = F.when((F.col("s0") >= F.col("s1")) & (F.col("s0") >= F.col("s2")), 0.0).when(F.col("s1") >= F.col("s2"), 1.0).otherwise(2.0)
    return rows.withColumn("prediction", best).select("o_orderkey", "label", "prediction", "scores")


SCORED_MULTI_SQL = f"""raw as (
  select o_orderkey, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as c,
    {u01_sql('o_orderkey*3')} as u0, {u01_sql('(o_orderkey*3+1)')} as u1, {u01_sql('(o_orderkey*3+2)')} as u2 from orders),
lean as (select o_orderkey, c::double as label,
    u0 + case when c=0 then 0.25::double else 0.0::double end as s0,
    u1 + case when c=1 then 0.25::double else 0.0::double end as s1,
    u2 + case when c=2 then 0.25::double else 0.0::double end as s2 from raw),
scored as (select o_orderkey, label,
    case when s0>=s1 and s0>=s2 then 0.0::double when s1>=s2 then 1.0::double else 2.0::double end as prediction,
    round(s0/(s0+s1+s2),6) as p0, round(s1/(s0+s1+s2),6) as p1, round(s2/(s0+s1+s2),6) as p2 from lean)"""


def scored_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx(spark, sf_dir).select(
        "o_orderkey", F.col("y").alias("label"), (F.col("o_totalprice") / 100000.0 + 1.0).alias("prediction")
    )


SCORED_REGRESSION_SQL = f"""{FX_SQL},
scored as (select o_orderkey, y as label, o_totalprice/100000.0::double+1.0::double as prediction from fx)"""
