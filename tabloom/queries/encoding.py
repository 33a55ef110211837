"""Queries for feature and label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode
from ..operators.split import stratified_holdout
from ..session import materialize
from .fixtures import FX_CLASS_SQL, fx_class, holdout_sql
from .prepare import CONSTANTS, with_constants

KEY = "o_orderkey"
CATEGORICAL = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "c_name"]
NUMERIC = ["o_totalprice", "c_acctbal", "c_nationkey"]

HELD_SQL = f"""{FX_CLASS_SQL}, {holdout_sql('fxc','level',KEY)}, train as (select * from held where not is_test)"""


def held(spark, sf_dir):
    return materialize(stratified_holdout(fx_class(spark, sf_dir), "level", KEY), "held")


def _fit(rows, categorical=(), numeric=()):
    return encode.Preprocessor.fit(rows.where(~F.col("is_test")), categorical, numeric)


def one_hot(spark, sf_dir):
    rows = held(spark, sf_dir)
    fitted = _fit(rows, ["o_orderpriority", "c_mktsegment"])
    long = fitted.wide(rows, [KEY])
    names = fitted.feature_names
    entries = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names]
    return long.select(KEY, F.explode(F.array(*entries)).alias("e")).select(KEY, "e.*")


ONE_HOT_SQL = f"""with {HELD_SQL},
vals as (select 'o_orderpriority' as c, o_orderpriority as v from train union select 'c_mktsegment', c_mktsegment from train),
kept as (select c, v from vals qualify row_number() over (partition by c order by v) > 1)
select o_orderkey, 'OneHotEncoder__'||c||'_'||v as feature,
  cast((case c when 'o_orderpriority' then o_orderpriority else c_mktsegment end)=v as int)::double as value from held, kept"""


def ordinal_encode(spark, sf_dir):
    train = held(spark, sf_dir).where(~F.col("is_test"))
    fitted = encode.Preprocessor.fit(train, ["c_name"], [])
    return fitted.wide(train, [KEY]).withColumnRenamed("OrdinalEncoder__c_name", "code")


ORDINAL_SQL = f"""with {HELD_SQL}, dict as (select v, row_number() over (order by v)-1 as code from (select distinct c_name as v from train))
select o_orderkey, code::double as code from train join dict on c_name=v"""


def ordinal_unseen(spark, sf_dir):
    """Codes from the train rows applied to the whole table; a name outside them gets -1."""
    rows = held(spark, sf_dir)
    fitted = _fit(rows, ["c_name"])
    return fitted.wide(rows, [KEY]).withColumnRenamed("OrdinalEncoder__c_name", "code")


UNSEEN_SQL = f"""with {HELD_SQL}, dict as (select v, row_number() over (order by v)-1 as code from (select distinct c_name as v from train))
select o_orderkey, coalesce(code,-1)::double as code from held left join dict on c_name=v"""


def standard_scale(spark, sf_dir):
    rows = with_constants(held(spark, sf_dir))
    fitted = _fit(rows, [], [*NUMERIC, *CONSTANTS])
    wide = fitted.wide(rows, [KEY])
    return wide.select(KEY, *[F.round(f"StandardScaler__{c}", 6).alias(c) for c in [*NUMERIC, *CONSTANTS]])


def _scale_sql() -> str:
    out = ", ".join(f"round(({c}-(select avg({c}) from train))/(select stddev_pop({c}) from train),6) as {c}" for c in NUMERIC)
    return f"with {HELD_SQL} select o_orderkey, {out}, 0.0::double as flat, 0.0::double as tenth from held"


def preprocess_wide(spark, sf_dir):
    rows = with_constants(held(spark, sf_dir))
    fitted = _fit(rows, CATEGORICAL, [*NUMERIC, "tenth"])
    wide = fitted.wide(rows, [KEY, "is_test"])
    return wide.select(KEY, "is_test", *[F.round(f"`{n}`", 6).alias(f"f{i}") for i, n in enumerate(fitted.feature_names)])


def _wide_sql() -> str:
    statuses = ["O", "P"]
    priorities = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    segments = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out, i = [], 0
    for column, values in (("o_orderstatus", statuses), ("o_orderpriority", priorities), ("c_mktsegment", segments)):
        for v in values:
            out.append(f"cast({column}='{v}' as int)::double as f{i}")
            i += 1
    out.append(f"coalesce(code,-1)::double as f{i}")
    i += 1
    for c in NUMERIC:
        out.append(f"round(({c}-(select avg({c}) from train))/(select stddev_pop({c}) from train),6) as f{i}")
        i += 1
    out.append(f"0.0::double as f{i}")
    return f"""with {HELD_SQL}, dict as (select v, row_number() over (order by v)-1 as code from (select distinct c_name as v from train))
select o_orderkey, is_test, {", ".join(out)} from held left join dict on c_name=v"""


def feature_names(spark, sf_dir):
    rows = held(spark, sf_dir)
    fitted = _fit(rows, CATEGORICAL, NUMERIC)
    return spark.createDataFrame(list(enumerate(fitted.feature_names)), "position int, name string")


def feature_display_names(spark, sf_dir):
    rows = held(spark, sf_dir)
    fitted = _fit(rows, CATEGORICAL, NUMERIC)
    return spark.createDataFrame(list(enumerate(fitted.display_names)), "position int, name string")


def _names_sql(one_hot: str, ordinal: str, scaled: str) -> str:
    parts = [
        f"select {i} as g, '{c}' as c, v from (select distinct {c} as v from train) qualify row_number() over (order by v)>1"
        for i, c in enumerate(CATEGORICAL[:3])
    ]
    numeric = " union all ".join(f"select {10 + i} as g, {scaled.format(c=c)} as name, '' as v" for i, c in enumerate(NUMERIC))
    return f"""with {HELD_SQL}, oh as ({" union all ".join(f"({p})" for p in parts)}),
every as (select g, {one_hot} as name, v from oh union all select 9, {ordinal.format(c="c_name")}, '' union all {numeric})
select (row_number() over (order by g, v)-1)::int as position, name from every"""


def label_encode(spark, sf_dir):
    rows = held(spark, sf_dir)
    labels = encode.label_dictionary(rows.where(~F.col("is_test")), "level")
    return encode.encode_label(rows.select(KEY, "level"), labels, "level")


LABEL_SQL = f"""with {HELD_SQL}, dict as (select v, (row_number() over (order by v)-1)::double as label from (select distinct level as v from train))
select o_orderkey, level, label from held join dict on level=v"""


def label_dictionary(spark, sf_dir):
    return encode.label_dictionary(fx_class(spark, sf_dir), "c_name")


def label_decode(spark, sf_dir):
    rows = held(spark, sf_dir)
    labels = encode.label_dictionary(rows.where(~F.col("is_test")), "level")
    coded = encode.encode_label(rows.select(KEY, "level"), labels, "level", "prediction").drop("level")
    return encode.decode_label(coded, labels)


def class_weights(spark, sf_dir):
    weighted = encode.class_weights(fx_class(spark, sf_dir).select(KEY, "high"), "high")
    return weighted.select(KEY, "high", F.round("weight", 9).alias("weight"))


WEIGHT_SQL = f"""with {FX_CLASS_SQL}, c as (select high as h, count(*) as n from fxc group by 1)
select o_orderkey, high, round((select sum(n) from c)::double/(n*(select count(*) from c)),9) as weight from fxc join c on high=h"""

QUERIES = {
    "one_hot": (one_hot, ONE_HOT_SQL),
    "ordinal_encode": (ordinal_encode, ORDINAL_SQL),
    "ordinal_unseen": (ordinal_unseen, UNSEEN_SQL),
    "standard_scale": (standard_scale, _scale_sql()),
    "preprocess_wide": (preprocess_wide, _wide_sql()),
    "feature_names": (feature_names, _names_sql("'OneHotEncoder__'||c||'_'||v", "'OrdinalEncoder__{c}'", "'StandardScaler__{c}'")),
    "feature_display_names": (feature_display_names, _names_sql("c||' : '||v", "'{c}'", "'{c}'")),
    "label_encode": (label_encode, LABEL_SQL),
    "label_dictionary": (
        label_dictionary,
        f"with {FX_CLASS_SQL} select v as value, (row_number() over (order by v)-1)::double as label from (select distinct c_name as v from fxc)",
    ),
    "label_decode": (label_decode, f"with {HELD_SQL} select o_orderkey, level as prediction from held"),
    "class_weights": (class_weights, WEIGHT_SQL),
}
