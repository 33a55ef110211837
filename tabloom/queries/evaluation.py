"""Queries for metrics, leaderboards and diagnostic tables.

The leaderboards are not literals: each model is a simple rule whose predictions and
metrics come from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import u01
from ..operators import curves, leaderboard, metrics
from ..operators.split import random_holdout, stratified_holdout
from .fixtures import (
    FX_CLASS_SQL,
    FX_SQL,
    SCORED_BINARY_SQL,
    SCORED_MULTI_SQL,
    SCORED_REGRESSION_SQL,
    fx,
    fx_class,
    holdout_sql,
    random_holdout_sql,
    scored_binary,
    scored_multi,
    scored_regression,
    u01_sql,
)

KEY = "o_orderkey"


def rounded(df, *names, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def metric_regression(spark, sf_dir):
    return rounded(metrics.regression_metrics(scored_regression(spark, sf_dir)), "mae", "mse", "rmse", "r2")


METRIC_REGRESSION_SQL = f"""with {SCORED_REGRESSION_SQL}
select round(avg(abs(label-prediction)),6) as mae, round(avg(pow(label-prediction,2)),6) as mse,
  round(sqrt(avg(pow(label-prediction,2))),6) as rmse, round(1-avg(pow(label-prediction,2))/var_pop(label),6) as r2 from scored"""

FOUR = ("accuracy", "f1", "precision", "recall")


def metric_classification_binary(spark, sf_dir):
    return rounded(metrics.binary_metrics(scored_binary(spark, sf_dir)), *FOUR)


METRIC_BINARY_SQL = f"""with {SCORED_BINARY_SQL},
c as (select avg(cast(label=prediction as int)) as acc, count(*) filter (label=1 and prediction=1)::double as tp,
  count(*) filter (prediction=1) as pp, count(*) filter (label=1) as ap from scored)
select round(acc,6) as accuracy, round(2*tp/(pp+ap),6) as f1, round(tp/pp,6) as precision, round(tp/ap,6) as recall from c"""


def metric_classification_weighted(spark, sf_dir):
    return rounded(metrics.weighted_metrics(scored_multi(spark, sf_dir)), *FOUR)


METRIC_WEIGHTED_SQL = f"""with {SCORED_MULTI_SQL},
c as (select c as cl, count(*) filter (label=c)::double as s, count(*) filter (prediction=c)::double as p,
   count(*) filter (label=c and prediction=c)::double as h from scored, range(3) r(c) group by 1)
select round(sum(h)/sum(s),6) as accuracy, round(sum(s*2*h/(p+s))/sum(s),6) as f1,
  round(sum(s*h/p)/sum(s),6) as precision, round(sum(s*h/s)/sum(s),6) as recall from c"""


def metric_roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(scored_binary(spark, sf_dir)), "auc", digits=9)


ROC_AUC_SQL = f"""with {SCORED_BINARY_SQL},
g as (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from scored group by 1),
c as (select pos, neg, sum(neg) over (order by score)-neg*0.5::double as below from g)
select round(sum(pos*below)/(sum(pos)::double*sum(neg)),9) as auc from c"""


def metric_roc_auc_ovr(spark, sf_dir):
    return rounded(metrics.one_vs_rest_auc(scored_multi(spark, sf_dir), 3), "auc", digits=9)


ROC_OVR_SQL = f"""with {SCORED_MULTI_SQL},
l as (select 0 as c, p0 as score, label=0 as y from scored union all select 1, p1, label=1 from scored union all select 2, p2, label=2 from scored),
g as (select c, score, count(*) filter (y) as pos, count(*) filter (not y) as neg from l group by 1,2),
w as (select c, pos, neg, sum(neg) over (partition by c order by score)-neg*0.5::double as below from g),
a as (select c, sum(pos*below)/(sum(pos)::double*sum(neg)) as auc, sum(pos) as p from w group by 1)
select round(sum(auc*p)/sum(p),9) as auc from a"""


def confusion_matrix(spark, sf_dir):
    return curves.confusion_matrix(scored_multi(spark, sf_dir))


CONFUSION_SQL = f"""with {SCORED_MULTI_SQL}, k as (select c::double as c from range(3) r(c))
select a.c as label, b.c as prediction, (select count(*) from scored s where s.label=a.c and s.prediction=b.c) as n from k a, k b"""


def roc_points(spark, sf_dir):
    points = curves.roc_points(scored_binary(spark, sf_dir))
    return rounded(points.withColumn("threshold", F.when(F.col("threshold") < 1e300, F.col("threshold"))), "threshold", "fpr", "tpr", digits=9)


ROC_POINTS_SQL = f"""with {SCORED_BINARY_SQL},
g as (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from scored group by 1),
c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from g)
select round(score,9) as threshold, round(fp/(select sum(neg) from g)::double,9) as fpr, round(tp/(select sum(pos) from g)::double,9) as tpr from c
union all select null, 0.0::double, 0.0::double"""


def pr_points(spark, sf_dir):
    points = curves.pr_points(scored_binary(spark, sf_dir))
    return rounded(
        points.withColumn("threshold", F.when(F.col("threshold") < 1e300, F.col("threshold"))),
        "threshold", "precision", "recall", digits=9,
    )


PR_POINTS_SQL = f"""with {SCORED_BINARY_SQL},
g as (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from scored group by 1),
c as (select score, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp from g)
select round(score,9) as threshold, round(tp/(tp+fp)::double,9) as precision, round(tp/(select sum(pos) from g)::double,9) as recall from c
union all select null, 1.0::double, 0.0::double"""


def residuals(spark, sf_dir):
    return rounded(curves.residuals(scored_regression(spark, sf_dir)).drop("label"), "prediction", "residual", digits=9)


def actual_vs_predicted(spark, sf_dir):
    return rounded(curves.actual_vs_predicted(scored_regression(spark, sf_dir)), "label", "prediction", "low", "high", digits=9)


def residual_histogram(spark, sf_dir):
    return rounded(curves.residual_histogram(scored_regression(spark, sf_dir)), "low", "high")


HISTOGRAM_SQL = f"""with {SCORED_REGRESSION_SQL}, x as (select label-prediction as r from scored),
s as (select count(*) as n, min(r) as lo, max(r) as hi, quantile_cont(r,0.75)-quantile_cont(r,0.25) as iqr from x),
w as (select *, ceil((hi-lo)/least((hi-lo)/(log2(n)+1), 2*iqr/pow(n,1.0::double/3)))::int as bins from s),
b as (select *, (hi-lo)/bins as width from w),
c as (select least(floor((r-lo)/width), bins-1)::int as bin, count(*) as n from x, b group by 1)
select g.bin::int as bin, round(lo+g.bin*width,6) as low, round(lo+(g.bin+1)*width,6) as high, coalesce(c.n,0)::bigint as n
from b, (select unnest(range((select bins from b))) as bin) g left join c on c.bin=g.bin"""


def residual_kde(spark, sf_dir):
    return rounded(curves.residual_kde(scored_regression(spark, sf_dir)), "x", "density")


KDE_SQL = f"""with {SCORED_REGRESSION_SQL}, x as (select label-prediction as r from scored),
s as (select count(*) as n, stddev_samp(r)*pow(count(*),-0.2::double) as h, min(r) as lo, max(r) as hi from x),
b as (select least(floor((r-lo)/((hi-lo)/4096)),4095) as bin, count(*) as w, avg(r) as c from x, s group by 1),
g as (select lo+i*((hi-lo)/199) as x, n, h from s, range(200) t(i))
select round(g.x,6) as x, round(sum(w*exp(-0.5::double*pow((g.x-c)/h,2)))/(any_value(n)*any_value(h)*sqrt(2*pi())),6) as density from g, b group by g.x"""


# ---- leaderboards from rules -------------------------------------------------------

REGRESSION_WEIGHT, CLASSIFICATION_WEIGHT = 0.3, 0.7


def _regression_rules(rows, tuned: bool):
    """Predictions of rules fitted on the train rows, as (model, is_test, label, prediction)."""
    train = rows.where(~F.col("is_test"))
    s = train.agg(
        F.avg("y").alias("m"),
        F.regr_slope("y", "o_totalprice").alias("pb"),
        F.regr_intercept("y", "o_totalprice").alias("pa"),
        F.regr_slope("y", "c_acctbal").alias("ab"),
        F.regr_intercept("y", "c_acctbal").alias("aa"),
    ).first()
    price = F.lit(s["pa"]) + F.lit(s["pb"]) * F.col("o_totalprice")
    account = F.lit(s["aa"]) + F.lit(s["ab"]) * F.col("c_acctbal")
    if tuned:
        rules = {"price": price + account - F.lit(s["m"]), "account": account * 0.9 + F.lit(s["m"]) * 0.1, "mean": F.lit(s["m"])}
    else:
        rules = {"mean": F.lit(s["m"]), "price": price, "account": account, "half": (price + account) / 2.0, "zero": F.lit(0.0)}
    entries = [F.struct(F.lit(n).alias("model"), p.cast("double").alias("prediction")) for n, p in rules.items()]
    return rows.select("is_test", F.col("y").alias("label"), F.explode(F.array(*entries)).alias("e")).select(
        "is_test", "label", "e.model", "e.prediction"
    )


def regression_board(spark, sf_dir, tuned: bool = False):
    scored = _regression_rules(random_holdout(fx(spark, sf_dir), KEY), tuned)
    table = metrics.regression_metrics(scored, ["model", "is_test"])
    wide = table.groupBy("model").agg(
        *[
            F.max(F.when(F.col("is_test") == flag, F.round(m, 6))).alias(f"{part}_{m}")
            for part, flag in (("train", False), ("test", True))
            for m in ("rmse", "r2")
        ]
    )
    return wide.withColumn("tuned", F.lit(tuned))


def _regression_board_sql(tuned: bool, name: str) -> str:
    if tuned:
        rules = {"price": "price+account-m", "account": "account*0.9::double+m*0.1::double", "mean": "m"}
    else:
        rules = {"mean": "m", "price": "price", "account": "account", "half": "(price+account)/2.0::double", "zero": "0.0::double"}
    union = " union all ".join(f"select '{n}' as model, is_test, y as label, {e} as prediction from base" for n, e in rules.items())
    return f"""{name}_s as ({union}),
{name}_m as (select model, is_test, round(sqrt(avg(pow(label-prediction,2))),6) as rmse,
   round(1-avg(pow(label-prediction,2))/var_pop(label),6) as r2 from {name}_s group by 1,2),
{name} as (select model, max(rmse) filter (not is_test) as train_rmse, max(r2) filter (not is_test) as train_r2,
   max(rmse) filter (is_test) as test_rmse, max(r2) filter (is_test) as test_r2, {str(tuned).lower()} as tuned from {name}_m group by 1)"""


REGRESSION_BASE_SQL = f"""{FX_SQL}, {random_holdout_sql('fx', KEY)},
st as (select avg(y) as m, regr_slope(y,o_totalprice) as pb, regr_intercept(y,o_totalprice) as pa,
  regr_slope(y,c_acctbal) as ab, regr_intercept(y,c_acctbal) as aa from held where not is_test),
base as (select h.*, st.m, pa+pb*o_totalprice as price, aa+ab*c_acctbal as account from held h, st),
{_regression_board_sql(False, 'board')}"""


def _score_regression_sql(source: str, name: str) -> str:
    w = REGRESSION_WEIGHT
    return f"""{name}_t as (select *, train_rmse+test_rmse as total_rmse, train_r2+test_r2 as total_r2 from {source}),
{name}_n as (select *, total_rmse/max(total_rmse) over () as norm_rmse, 1-total_r2/max(total_r2) over () as norm_r2 from {name}_t),
{name} as (select *, {w}::double*norm_rmse+{1 - w}::double*norm_r2 as combined_score from {name}_n)"""


REGRESSION_OUT = ["train_rmse", "train_r2", "test_rmse", "test_r2", "norm_rmse", "norm_r2", "combined_score"]


def _regression_out(df):
    return rounded(df.select("model", "tuned", *REGRESSION_OUT), *REGRESSION_OUT)


OUT_REG_SQL = "model, tuned, " + ", ".join(f"round({c},6) as {c}" for c in REGRESSION_OUT)


def score_regression(spark, sf_dir):
    return _regression_out(leaderboard.score_regression(regression_board(spark, sf_dir), REGRESSION_WEIGHT))


def top_models(spark, sf_dir):
    return _regression_out(leaderboard.rank_models(regression_board(spark, sf_dir), "regression", REGRESSION_WEIGHT))


def rerank_union(spark, sf_dir):
    top = leaderboard.rank_models(regression_board(spark, sf_dir), "regression", REGRESSION_WEIGHT)
    tuned = regression_board(spark, sf_dir, tuned=True)
    return _regression_out(leaderboard.rerank(top, tuned, "regression", REGRESSION_WEIGHT, n=None))


COLS_REG = "model, tuned, train_rmse, train_r2, test_rmse, test_r2"

RERANK_SQL = f"""with {REGRESSION_BASE_SQL}, {_score_regression_sql('board', 'sc')},
top3 as (select {COLS_REG} from sc order by combined_score, model limit 3),
{_regression_board_sql(True, 'tboard')},
un as (select {COLS_REG} from top3 union all select {COLS_REG} from tboard),
{_score_regression_sql('un', 'fin')} select {OUT_REG_SQL} from fin"""


def topk_semijoin(spark, sf_dir):
    """The search-space rows of the top models only."""
    from ..models.spaces import REGRESSION_SPACES

    names = ["mean", "price", "account", "half", "zero"]
    spaces = [(m, p, len(v)) for m, (_, grid) in zip(names, REGRESSION_SPACES.items()) for p, v in grid.items()]
    table = spark.createDataFrame(spaces, "model string, parameter string, n_values int")
    top = leaderboard.rank_models(regression_board(spark, sf_dir), "regression", REGRESSION_WEIGHT)
    return leaderboard.spaces_of_top(table, top)


def _semijoin_sql() -> str:
    from ..models.spaces import REGRESSION_SPACES

    names = ["mean", "price", "account", "half", "zero"]
    rows = ",".join(f"('{m}','{p}',{len(v)})" for m, (_, grid) in zip(names, REGRESSION_SPACES.items()) for p, v in grid.items())
    return f"""with {REGRESSION_BASE_SQL}, {_score_regression_sql('board', 'sc')}, sp(model, parameter, n_values) as (values {rows})
select model, parameter, n_values::int as n_values from sp where model in (select model from sc order by combined_score, model limit 3)"""


def _classification_rules(rows):
    """Rules for the even class; `memory` knows the train labels and guesses on the test rows."""
    positive = (F.col("level") == "hi").cast("double")
    rules = {
        "price": F.col("o_totalprice") > 250000,
        "account": F.col("c_acctbal") > 4500,
        "urgent": F.col("o_orderpriority") == "1-URGENT",
        "both": F.col("o_totalprice") / 100000.0 + F.col("c_acctbal") / 5000.0 > 3.5,
        "memory": F.when(F.col("is_test"), u01(KEY, F.lit("guess")) < 0.5).otherwise(F.col("level") == "hi"),
    }
    entries = [F.struct(F.lit(n).alias("model"), p.cast("double").alias("prediction")) for n, p in rules.items()]
    return rows.select("is_test", positive.alias("label"), F.explode(F.array(*entries)).alias("e")).select(
        "is_test", "label", "e.model", "e.prediction"
    )


def classification_board(spark, sf_dir):
    scored = _classification_rules(stratified_holdout(fx_class(spark, sf_dir), "level", KEY))
    table = metrics.binary_metrics(scored, ["model", "is_test"])
    wide = table.groupBy("model").agg(
        *[
            F.max(F.when(F.col("is_test") == flag, F.round(m, 6))).alias(f"{part}_{m}")
            for part, flag in (("train", False), ("test", True))
            for m in FOUR
        ]
    )
    return wide.withColumn("tuned", F.lit(False))


def _classification_board_sql() -> str:
    rules = {
        "price": "o_totalprice>250000",
        "account": "c_acctbal>4500",
        "urgent": "o_orderpriority='1-URGENT'",
        "both": "o_totalprice/100000.0::double+c_acctbal/5000.0::double>3.5::double",
        "memory": f"case when is_test then {u01_sql(KEY, chr(39) + 'guess' + chr(39))}<0.5 else level='hi' end",
    }
    union = " union all ".join(
        f"select '{n}' as model, is_test, level='hi' as label, {e} as prediction from held" for n, e in rules.items()
    )
    parts = ", ".join(
        f"max({m}) filter ({'' if part == 'test' else 'not '}is_test) as {part}_{m}" for part in ("train", "test") for m in FOUR
    )
    return f"""{FX_CLASS_SQL}, {holdout_sql('fxc','level',KEY)}, s as ({union}),
c as (select model, is_test, avg(cast(label=prediction as int)) as acc, count(*) filter (label and prediction)::double as tp,
  count(*) filter (prediction) as pp, count(*) filter (label) as ap from s group by 1,2),
m as (select model, is_test, round(acc,6) as accuracy, round(2*tp/(pp+ap),6) as f1, round(tp/pp,6) as precision, round(tp/ap,6) as recall from c),
board as (select model, {parts} from m group by 1),
t as (select *, train_accuracy+test_accuracy as total_accuracy, train_f1+test_f1 as total_f1 from board),
n as (select *, total_f1/max(total_f1) over () as norm_f1, total_accuracy/max(total_accuracy) over () as norm_accuracy from t),
sc as (select *, {CLASSIFICATION_WEIGHT}::double*norm_f1+{1 - CLASSIFICATION_WEIGHT}::double*norm_accuracy as combined_score from n)"""


CLASS_OUT = ["train_accuracy", "train_f1", "test_accuracy", "test_f1", "norm_f1", "norm_accuracy", "combined_score"]
CLASS_OUT_SQL = "model, " + ", ".join(f"round({c},6) as {c}" for c in CLASS_OUT)


def score_classification(spark, sf_dir):
    scored = leaderboard.score_classification(classification_board(spark, sf_dir), CLASSIFICATION_WEIGHT)
    return rounded(scored.select("model", *CLASS_OUT), *CLASS_OUT)


def overfit_filter(spark, sf_dir):
    scored = leaderboard.score_classification(classification_board(spark, sf_dir), CLASSIFICATION_WEIGHT)
    return leaderboard.overfit_filter(scored).select("model", "train_f1", "test_f1")


def top_classifiers(spark, sf_dir):
    ranked = leaderboard.rank_models(classification_board(spark, sf_dir), "classification", CLASSIFICATION_WEIGHT)
    return rounded(ranked.select("model", *CLASS_OUT), *CLASS_OUT)


def report_projection(spark, sf_dir):
    """The best rule's row as the report shows it: four digits, one row."""
    best = leaderboard.rank_models(classification_board(spark, sf_dir), "classification", CLASSIFICATION_WEIGHT, 1)
    return best.select(
        F.lit("classification").alias("problem_type"), "model", "tuned",
        *[F.round(f"{p}_{m}", 4).alias(f"{p}_{m}") for p in ("train", "test") for m in FOUR],
    )


REPORT_SQL = f"""with {_classification_board_sql()}
select 'classification' as problem_type, model, false as tuned, {", ".join(f"round({p}_{m},4) as {p}_{m}" for p in ("train", "test") for m in FOUR)}
from sc where train_f1-test_f1<0.15 order by combined_score desc, model limit 1"""


def importance_shares(spark, sf_dir):
    """Squared correlation with the target as an importance, in percent of the total."""
    rows = fx(spark, sf_dir)
    names = ["o_totalprice", "c_acctbal", "c_nationkey"]
    one = rows.agg(*[F.pow(F.corr(n, "y"), 2).alias(n) for n in names])
    entries = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in names]
    long = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return rounded(curves.importance_shares(long), "importance", "percent")


IMPORTANCE_SQL = f"""with {FX_SQL}, i as (
 select 'o_totalprice' as feature, pow(corr(o_totalprice,y),2) as importance from fx union all
 select 'c_acctbal', pow(corr(c_acctbal,y),2) from fx union all
 select 'c_nationkey', pow(corr(c_nationkey,y),2) from fx)
select feature, round(importance,6) as importance, round(100*importance/sum(importance) over (),6) as percent from i"""

QUERIES = {
    "metric_regression": (metric_regression, METRIC_REGRESSION_SQL),
    "metric_classification_binary": (metric_classification_binary, METRIC_BINARY_SQL),
    "metric_classification_weighted": (metric_classification_weighted, METRIC_WEIGHTED_SQL),
    "metric_roc_auc": (metric_roc_auc, ROC_AUC_SQL),
    "metric_roc_auc_ovr": (metric_roc_auc_ovr, ROC_OVR_SQL),
    "confusion_matrix": (confusion_matrix, CONFUSION_SQL),
    "roc_points": (roc_points, ROC_POINTS_SQL),
    "pr_points": (pr_points, PR_POINTS_SQL),
    "residuals": (
        residuals,
        f"with {SCORED_REGRESSION_SQL} select o_orderkey, round(prediction,9) as prediction, round(label-prediction,9) as residual from scored",
    ),
    "actual_vs_predicted": (
        actual_vs_predicted,
        f"""with {SCORED_REGRESSION_SQL} select round(label,9) as label, round(prediction,9) as prediction,
  (select round(min(label),9) from scored) as low, (select round(max(label),9) from scored) as high from scored""",
    ),
    "residual_histogram": (residual_histogram, HISTOGRAM_SQL),
    "residual_kde": (residual_kde, KDE_SQL),
    "score_regression": (score_regression, f"with {REGRESSION_BASE_SQL}, {_score_regression_sql('board', 'sc')} select {OUT_REG_SQL} from sc"),
    "top_models": (
        top_models,
        f"with {REGRESSION_BASE_SQL}, {_score_regression_sql('board', 'sc')} select {OUT_REG_SQL} from sc order by combined_score, model limit 3",
    ),
    "rerank_union": (rerank_union, RERANK_SQL),
    "topk_semijoin": (topk_semijoin, _semijoin_sql()),
    "score_classification": (score_classification, f"with {_classification_board_sql()} select {CLASS_OUT_SQL} from sc"),
    "overfit_filter": (overfit_filter, f"with {_classification_board_sql()} select model, train_f1, test_f1 from sc where train_f1-test_f1<0.15"),
    "top_classifiers": (
        top_classifiers,
        f"with {_classification_board_sql()} select {CLASS_OUT_SQL} from sc where train_f1-test_f1<0.15 order by combined_score desc, model limit 3",
    ),
    "report_projection": (report_projection, REPORT_SQL),
    "importance_shares": (importance_shares, IMPORTANCE_SQL),
}
