"""Queries for models, search, training and scoring.

Tree models have exact SQL twins on indicator features, where a deep enough tree
separates the groups and its prediction has a closed form.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..models.base import FEATURES, KEY, LABEL, PREDICTION, load_model
from ..models.registry import fit_model
from ..operators import encode, metrics
from ..operators.split import random_holdout, stratified_holdout
from ..plans import evaluate, search
from ..plans.score import score
from ..plans.train import train
from ..session import materialize, scratch_path
from ..sources import artifacts
from .encoding import HELD_SQL
from .fixtures import FX_CLASS_SQL, FX_SQL, fx_class, holdout_sql, random_holdout_sql, table

CATEGORICAL = ["o_orderpriority", "c_mktsegment"]
NUMERIC = ["o_totalprice", "c_acctbal", "c_nationkey"]


def encoded(spark, sf_dir, task: str, label=None):
    """Encoded fx rows (row_key, is_test, label, features) and the fitted encoding."""
    rows = fx_class(spark, sf_dir)
    target = label if label is not None else (F.col("y") if task == "regression" else (F.col("level") == "hi"))
    # Stored, as the split reads its input once for each scan.
    rows = materialize(rows.withColumn(LABEL, target.cast("double")), "rows")
    held = random_holdout(rows, "o_orderkey") if task == "regression" else stratified_holdout(rows, LABEL, "o_orderkey")
    held = materialize(held.withColumn(KEY, F.col("o_orderkey").cast("string")), "held")
    fitted = encode.Preprocessor.fit(held.where(~F.col("is_test")), CATEGORICAL, NUMERIC)
    return materialize(fitted.transform(held, [KEY, "is_test", LABEL]), "encoded"), fitted


def terciles():
    """Three classes of the regression target."""
    return F.when(F.col("y") < 3.0, 0.0).when(F.col("y") < 5.0, 1.0).otherwise(2.0)


def _parts(data):
    columns = [KEY, LABEL, FEATURES]
    return data.where(~F.col("is_test")).select(columns), data.where("is_test").select(columns)


def fitted_predictions(name, task, params=None, classes=2, label=None):
    """Test rows with the prediction of a model fitted on all training rows."""

    def run(spark, sf_dir):
        data, _ = encoded(spark, sf_dir, task, label() if label else None)
        train_rows, test_rows = _parts(data)
        model = fit_model(name, train_rows, params or {}, classes)
        return model.predict(test_rows).select(KEY, LABEL, PREDICTION)

    return run


# ---- closed forms ------------------------------------------------------------------------


def _one_feature(spark, sf_dir, name, params):
    """Slope and intercept of a linear model on the price, in units of 100,000."""
    held = random_holdout(fx_class(spark, sf_dir), "o_orderkey").where(~F.col("is_test"))
    rows = held.select(
        F.col("o_orderkey").cast("string").alias(KEY),
        F.col("y").alias(LABEL),
        array_to_vector(F.array(F.col("o_totalprice") / 100000.0)).alias(FEATURES),
    )
    model = fit_model(name, materialize(rows, "one"), params).model
    out = [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))]
    return spark.createDataFrame(out, "slope double, intercept double")


def one_feature(name, params):
    return lambda spark, sf_dir: _one_feature(spark, sf_dir, name, params)


def _one_feature_sql(slope: str) -> str:
    return f"""with {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
m as (select count(*)::double as n, avg(y) as my, avg(o_totalprice/100000.0::double) as mx, var_pop(o_totalprice/100000.0::double) as vx,
  covar_pop(o_totalprice/100000.0::double, y) as c from held where not is_test),
b as (select *, {slope} as slope from m)
select round(slope,4) as slope, round(my-slope*mx,4) as intercept from b"""


def reg_linear(spark, sf_dir):
    """Least squares on price and balance, predictions for the test rows."""
    held = random_holdout(fx_class(spark, sf_dir), "o_orderkey")
    rows = held.select(
        F.col("o_orderkey").cast("string").alias(KEY),
        "is_test",
        F.col("y").alias(LABEL),
        array_to_vector(F.array(F.col("o_totalprice") / 100000.0, F.col("c_acctbal") / 5000.0)).alias(FEATURES),
    )
    train_rows, test_rows = _parts(materialize(rows, "two"))
    scored = fit_model("LinearRegression", train_rows).predict(test_rows)
    return scored.select(KEY, F.round(PREDICTION, 6).alias(PREDICTION))


TWO_SQL = f"""{FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
h as (select o_orderkey, is_test, y, o_totalprice/100000.0::double as a, c_acctbal/5000.0::double as b from held),
m as (select avg(y) as my, avg(a) as ma, avg(b) as mb, var_pop(a) as vaa, var_pop(b) as vbb, covar_pop(a,b) as vab,
  covar_pop(a,y) as vay, covar_pop(b,y) as vby from h where not is_test)"""

LINEAR_SQL = f"""with {TWO_SQL}, s as (select *, (vay*vbb-vby*vab)/(vaa*vbb-vab*vab) as wa, (vby*vaa-vay*vab)/(vaa*vbb-vab*vab) as wb from m)
select cast(o_orderkey as varchar) as row_key, round(my+wa*(a-ma)+wb*(b-mb),6) as prediction from h, s where is_test"""


def reg_nonnegative(spark, sf_dir):
    """The balance enters with its sign turned, so its coefficient is held at zero."""
    held = random_holdout(fx_class(spark, sf_dir), "o_orderkey")
    rows = held.select(
        F.col("o_orderkey").cast("string").alias(KEY),
        "is_test",
        F.col("y").alias(LABEL),
        array_to_vector(F.array(F.col("o_totalprice") / 100000.0, F.col("c_acctbal") / -5000.0)).alias(FEATURES),
    )
    train_rows, test_rows = _parts(materialize(rows, "two"))
    scored = fit_model("LinearRegression", train_rows, {"positive": True}).predict(test_rows)
    return scored.select(KEY, F.round(PREDICTION, 6).alias(PREDICTION))


NONNEGATIVE_SQL = f"""with {TWO_SQL}
select cast(o_orderkey as varchar) as row_key, round(my+(vay/vaa)*(a-ma),6) as prediction from h, m where is_test"""


def _priority_rows(spark, sf_dir):
    """Indicators of the order priority as the only features; labels y and level."""
    held = random_holdout(fx_class(spark, sf_dir), "o_orderkey").withColumn(KEY, F.col("o_orderkey").cast("string"))
    fitted = encode.Preprocessor.fit(held.where(~F.col("is_test")), ["o_orderpriority"], [])
    coded = fitted.transform(held.withColumn("hi", (F.col("y") > 4.0).cast("double")), [KEY, "is_test", "y", "hi"])
    return materialize(coded, "priority")


def group_tree(name, params, label="y"):
    def run(spark, sf_dir):
        data = _priority_rows(spark, sf_dir).withColumnRenamed(label, LABEL)
        train_rows, test_rows = _parts(data)
        scored = fit_model(name, train_rows, params).predict(test_rows)
        return scored.select(KEY, F.round(PREDICTION, 6).alias(PREDICTION))

    return run


def _group_sql(value: str, source: str = "y") -> str:
    return f"""with {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
t as (select o_orderpriority as g, y, cast(y>4.0 as int)::double as hi from held where not is_test),
s as (select avg(y) as base from t),
v as (select g, {value} as v from t, s group by g)
select cast(o_orderkey as varchar) as row_key, round(v,6) as prediction from held join v on g=o_orderpriority where is_test"""


def group_shares(name, params, label, classes=2):
    """Class shares of the test rows by a classifier on the priority indicators, to 6 digits."""

    def run(spark, sf_dir):
        data = _priority_rows(spark, sf_dir).withColumn(LABEL, label())
        train_rows, test_rows = _parts(data)
        scored = fit_model(name, train_rows, params, classes).predict(test_rows)
        shares = [F.round(F.col("scores")[k], 6).alias(f"share_{k}") for k in range(classes)]
        return scored.select(KEY, PREDICTION, *shares)

    return run


def _rounds_sql(start: str, step: str, share: str, rate: float, rounds: int) -> str:
    """A margin for each group, moved once a round: n rows, s of them of class 1, share `base` overall."""
    return f"""with recursive {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
t as (select o_orderpriority as g, cast(y>4.0 as int)::double as hi from held where not is_test),
c as (select g, count(*)::double as n, sum(hi) as s, (select avg(hi) from t) as base from t group by g),
r as (select 0 as k, g, n, s, {start} as m from c
  union all select k+1, g, n, s, m+{rate}::double*({step}) from r where k<{rounds}),
v as (select g, {share} as p from r where k={rounds})
select cast(o_orderkey as varchar) as row_key, (p>1-p)::int::double as prediction, round(1-p,6) as share_0, round(p,6) as share_1
from held join v on g=o_orderpriority where is_test"""


_SIGMOID = "(1/(1+exp(-m)))"
XGB_ROUNDS_SQL = _rounds_sql(
    "ln(base/(1-base))", f"(s-n*{_SIGMOID})/(n*{_SIGMOID}*(1-{_SIGMOID})+1.0::double)", _SIGMOID, 0.5, 4
)
EXPONENTIAL_ROUNDS_SQL = _rounds_sql(
    "ln(base/(1-base))/2", "(s*exp(-m)-(n-s)*exp(m))/(s*exp(-m)+(n-s)*exp(m))", "(1/(1+exp(-2*m)))", 0.1, 12
)


def _softmax_sql(rate: float, rounds: int) -> str:
    """Three margins for each group; a round moves each by its own Newton step, shrunk by 2/3."""
    total = "(exp(m0)+exp(m1)+exp(m2))"
    counts = ", ".join(f"count(*) filter (c={k})::double as s{k}" for k in range(3))
    moved = ", ".join(f"m{k}+{rate}::double*2/3*(s{k}-n*p{k})/(n*p{k}*(1-p{k}))" for k in range(3))
    shares = ", ".join(f"exp(m{k})/{total} as p{k}" for k in range(3))
    starts = ", ".join(f"ln(b{k}) as m{k}" for k in range(3))
    base = ", ".join(f"avg((c={k})::int::double) as b{k}" for k in range(3))
    return f"""with recursive {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
t as (select o_orderpriority as g, case when y<3.0 then 0 when y<5.0 then 1 else 2 end as c from held where not is_test),
r as (select 0 as k, g, n, s0, s1, s2, {starts} from (select g, count(*)::double as n, {counts} from t group by g), (select {base} from t)
  union all select k+1, g, n, s0, s1, s2, {moved} from (select *, {shares} from r) where k<{rounds}),
v as (select g, {shares} from r where k={rounds})
select cast(o_orderkey as varchar) as row_key,
  (case when p0>=p1 and p0>=p2 then 0 when p1>=p2 then 1 else 2 end)::double as prediction,
  round(p0,6) as share_0, round(p1,6) as share_1, round(p2,6) as share_2
from held join v on g=o_orderpriority where is_test"""


def _level_sql(at: float, rate: float, rounds: int) -> str:
    """Each round closes the share `rate` of the way from the overall level to the group's own."""
    return f"""with {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
t as (select o_orderpriority as g, y from held where not is_test),
v as (select g, quantile_disc(y,{at}) as q, (select quantile_disc(y,{at}) from t) as base from t group by g)
select cast(o_orderkey as varchar) as row_key, round(q+(base-q)*pow(1-{rate}::double,{rounds}),6) as prediction
from held join v on g=o_orderpriority where is_test"""


HUBER_GROUPS_SQL = f"""with {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
t as (select o_orderpriority as g, y from held where not is_test),
b as (select quantile_disc(y,0.5) as base from t),
d as (select quantile_disc(abs(y-base),0.9) as delta from t, b),
c as (select g, quantile_disc(y-base,0.5) as centre from t, b group by g),
v as (select g, any_value(base)+0.1::double*(any_value(centre)+avg(greatest(-delta,least(delta,y-base-centre)))) as v
  from t join c using (g), b, d group by g)
select cast(o_orderkey as varchar) as row_key, round(v,6) as prediction from held join v on g=o_orderpriority where is_test"""


def _is_high():
    return F.col("hi")


def reg_knn(spark, sf_dir):
    """Mean of the five nearest training rows by scaled price and balance."""
    held = random_holdout(fx_class(spark, sf_dir), "o_orderkey").withColumn(KEY, F.col("o_orderkey").cast("string"))
    rows = held.select(
        KEY,
        "is_test",
        F.col("y").alias(LABEL),
        array_to_vector(F.array(F.col("o_totalprice") / 100000.0, F.col("c_acctbal") / 5000.0)).alias(FEATURES),
    )
    train_rows, test_rows = _parts(materialize(rows, "knn"))
    scored = fit_model("KNeighborsRegressor", train_rows).predict(test_rows)
    return scored.select(KEY, F.round(PREDICTION, 6).alias(PREDICTION))


REG_KNN_SQL = f"""with {FX_SQL}, {random_holdout_sql('fx', 'o_orderkey')},
h as (select cast(o_orderkey as varchar) as k, is_test, y, o_totalprice/100000.0::double as a, c_acctbal/5000.0::double as b from held),
d as (select q.k, t.y, t.k as n, round(sqrt((q.a-t.a)*(q.a-t.a)+(q.b-t.b)*(q.b-t.b)),9) as d from h q, h t where q.is_test and not t.is_test),
r as (select k, unnest(arg_min(y, (d, n), 5)) as y from d group by k)
select k as row_key, round(avg(y),6) as prediction from r group by k"""


def clf_knn(spark, sf_dir):
    """Vote of the five nearest training embeddings, smallest label on a tie."""
    e = table(spark, sf_dir, "embeddings")
    held = stratified_holdout(e, "label", "vec_id").select(
        F.col("vec_id").cast("string").alias(KEY),
        "is_test",
        F.col("label").cast("double").alias(LABEL),
        array_to_vector(F.col("embedding").cast("array<double>")).alias(FEATURES),
    )
    train_rows, test_rows = _parts(materialize(held, "knn"))
    scored = fit_model("KNeighborsClassifier", train_rows, {}, 10).predict(test_rows)
    return scored.select(KEY, PREDICTION, F.round(F.array_max("scores"), 6).alias("share"))


CLF_KNN_SQL = f"""with {holdout_sql('embeddings', 'label', 'vec_id')},
h as (select cast(vec_id as varchar) as k, is_test, label, embedding::double[] as v from held),
d as (select q.k, t.label, t.k as n, round(sqrt(list_sum(list_transform(list_zip(q.v,t.v), lambda x: (x[1]-x[2])*(x[1]-x[2])))),9) as d
  from h q, h t where q.is_test and not t.is_test),
r as (select * from d qualify row_number() over (partition by k order by d, n)<=5),
c as (select k, label, count(*)/5.0::double as share from r group by 1,2)
select k as row_key, label::double as prediction, round(share,6) as share from c qualify row_number() over (partition by k order by share desc, label)=1"""


# ---- state, scoring, jobs -----------------------------------------------------------------


def preprocessor_state(spark, sf_dir):
    """The fitted encoding, saved and read back."""
    held = stratified_holdout(fx_class(spark, sf_dir), "level", "o_orderkey")
    fitted = encode.Preprocessor.fit(held.where(~F.col("is_test")), ["c_mktsegment", "c_name"], NUMERIC)
    path = scratch_path(spark, "state")
    fitted.state(spark).write.parquet(path)
    again = encode.Preprocessor.from_state(spark.read.parquet(path)).state(spark)
    return again.select("column", "encoder", "value", "code", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _state_sql() -> str:
    numeric = " union all ".join(
        f"select '{c}', 'StandardScaler', null, null, round(avg({c}),6), round(stddev_pop({c}),6) from train" for c in NUMERIC
    )
    return f"""with {HELD_SQL}
select 'c_mktsegment' as "column", 'OneHotEncoder' as encoder, v as value, row_number() over (order by v)-1 as code,
  null::double as mean, null::double as std from (select distinct c_mktsegment as v from train)
union all select 'c_name', 'OrdinalEncoder', v, row_number() over (order by v)-1, null, null from (select distinct c_name as v from train)
union all {numeric}"""


def model_save_load(spark, sf_dir):
    """Predictions of a saved and reloaded boosted model."""
    data, _ = encoded(spark, sf_dir, "classification")
    train_rows, test_rows = _parts(data)
    model = fit_model("XGBClassifier", train_rows, {"n_estimators": 3, "max_depth": 3})
    path = scratch_path(spark, "model")
    model.save(spark, path)
    return load_model(spark, path).predict(test_rows).select(KEY, LABEL, PREDICTION)


def leaderboard(spark, sf_dir):
    """Metrics of several classifiers on the same split."""
    data, _ = encoded(spark, sf_dir, "classification")
    train_rows, _ = _parts(data)
    rows = []
    jobs = {
        "LogisticRegression": {},
        "DecisionTreeClassifier": {"max_depth": 8},
        "RandomForestClassifier": {"n_estimators": 10, "max_depth": 8},
        "AdaBoostClassifier": {"n_estimators": 5},
    }
    for name, params in jobs.items():
        found = evaluate.evaluate(evaluate.scored_rows(fit_model(name, train_rows, params), data), "classification", 2)
        rows.append((name, *[found[f"{p}_{m}"] for p in ("train", "test") for m in ("accuracy", "f1", "rocauc_score")]))
    columns = ", ".join(f"{p}_{m} double" for p in ("train", "test") for m in ("accuracy", "f1", "rocauc_score"))
    return spark.createDataFrame(rows, f"model string, {columns}")


def random_search_query(spark, sf_dir):
    data, _ = encoded(spark, sf_dir, "regression")
    train_rows, _ = _parts(data)
    _, trials = search.random_search(train_rows, "Ridge", "regression", n_iter=4, n_splits=3)
    return trials.select("model", "trial", F.to_json("params").alias("params"), F.round("score", 4).alias("score"))


def learning_curve_accuracy(spark, sf_dir):
    data, _ = encoded(spark, sf_dir, "classification")
    return evaluate.learning_curve("DecisionTreeClassifier", {"max_depth": 6}, _parts(data)[0], "classification", 2, 3, 4)


def learning_curve_r2(spark, sf_dir):
    data, _ = encoded(spark, sf_dir, "regression")
    return evaluate.learning_curve("LinearRegression", {}, _parts(data)[0], "regression", 0, 3, 4)


def feature_importance(spark, sf_dir):
    from ..operators.curves import importance_shares

    data, fitted = encoded(spark, sf_dir, "regression")
    model = fit_model("DecisionTreeRegressor", _parts(data)[0], {"max_depth": 6})
    rows = [(n, float(v)) for n, v in zip(fitted.display_names, model.importances)]
    return importance_shares(spark.createDataFrame(rows, "feature string, importance double"))


def _small_run(spark, sf_dir, out=None):
    rows = fx_class(spark, sf_dir).drop("y", "high", "c_name")
    return train(
        rows, "level", 0.3, 0.7, key="o_orderkey", n_iter=2, n_splits=2, out=out,
        models=["LogisticRegression", "DecisionTreeClassifier"], curves=False, spark=spark,
    )


def train_end_to_end(spark, sf_dir):
    """The final ranking of a short run over the whole table."""
    board = _small_run(spark, sf_dir).leaderboard
    return board.select("model", "tuned", "train_f1", "test_f1", "combined_score")


def score_batch(spark, sf_dir):
    """Every row scored with a saved run, class names decoded."""
    out = scratch_path(spark, "run")
    run = _small_run(spark, sf_dir, out)
    rows = fx_class(spark, sf_dir).drop("y", "high", "c_name", "level")
    return score(rows, run.path, spark).select("o_orderkey", PREDICTION)


def report_text(spark, sf_dir):
    out = scratch_path(spark, "run")
    run = _small_run(spark, sf_dir, out)
    artifacts.load_artifacts(spark, run.path)
    return spark.read.text(f"{run.path}/report/text")


def flagship_metrics(spark, sf_dir):
    """Clean, split, encode, logistic regression, metrics: one row."""
    data, _ = encoded(spark, sf_dir, "classification")
    train_rows, test_rows = _parts(data)
    scored = fit_model("LogisticRegression", train_rows).predict(test_rows)
    scored = scored.select(F.lit("test").alias("part"), LABEL, PREDICTION, F.col("scores")[1].alias("score"))
    scored = materialize(scored, "scored")
    return metrics.binary_metrics(scored, ["part"]).join(metrics.roc_auc(scored, ["part"]), "part")


QUERIES = {
    "flagship_metrics": (flagship_metrics, None),
    "reg_linear": (reg_linear, LINEAR_SQL),
    "reg_linear_1d": (one_feature("LinearRegression", {}), _one_feature_sql("c/vx")),
    "reg_ridge_1d": (one_feature("Ridge", {"alpha": 100.0}), _one_feature_sql("n*c/(n*vx+100.0::double)")),
    "reg_lasso_1d": (one_feature("Lasso", {"alpha": 0.1}), _one_feature_sql("(c-0.1::double)/vx")),
    "reg_elastic_1d": (
        one_feature("ElasticNet", {"alpha": 0.1, "l1_ratio": 0.5}),
        _one_feature_sql("(c-0.05::double)/(vx+0.05::double)"),
    ),
    "reg_nonnegative": (reg_nonnegative, NONNEGATIVE_SQL),
    "reg_tree_groups": (group_tree("DecisionTreeRegressor", {"max_depth": 5}), _group_sql("avg(y)")),
    "reg_tree_poisson": (
        group_tree("DecisionTreeRegressor", {"max_depth": 5, "criterion": "poisson"}, "hi"), _group_sql("avg(hi)")
    ),
    "reg_tree_absolute": (
        group_tree("DecisionTreeRegressor", {"max_depth": 5, "criterion": "absolute_error"}), _group_sql("median(y)")
    ),
    "reg_gbt_groups": (group_tree("GradientBoostingRegressor", {"n_estimators": 1, "max_depth": 5}), _group_sql("avg(y)")),
    "reg_xgb_groups": (
        group_tree("XGBRegressor", {"n_estimators": 1, "max_depth": 5, "learning_rate": 1.0, "reg_lambda": 1.0}),
        _group_sql("any_value(base)+sum(y-base)/(count(*)+1.0::double)"),
    ),
    "reg_gbt_rounds": (group_tree("GradientBoostingRegressor", {"n_estimators": 6, "max_depth": 5}), _group_sql("avg(y)")),
    "reg_xgb_rounds": (
        group_tree("XGBRegressor", {"n_estimators": 6, "max_depth": 5, "learning_rate": 0.3, "reg_lambda": 1.0}),
        _group_sql("any_value(base)+(avg(y)-any_value(base))*(1-pow(1-0.3::double*count(*)/(count(*)+1.0::double),6))"),
    ),
    "reg_gbt_absolute_rounds": (
        group_tree("GradientBoostingRegressor", {"n_estimators": 3, "max_depth": 5, "loss": "absolute_error"}),
        _level_sql(0.5, 0.1, 3),
    ),
    "reg_gbt_quantile_rounds": (
        group_tree("GradientBoostingRegressor", {"n_estimators": 3, "max_depth": 5, "loss": "quantile"}),
        _level_sql(0.9, 0.1, 3),
    ),
    "reg_gbt_huber_groups": (
        group_tree("GradientBoostingRegressor", {"n_estimators": 1, "max_depth": 5, "loss": "huber"}), HUBER_GROUPS_SQL
    ),
    "clf_xgb_rounds": (
        group_shares("XGBClassifier", {"n_estimators": 4, "max_depth": 5, "learning_rate": 0.5, "reg_lambda": 1.0}, _is_high),
        XGB_ROUNDS_SQL,
    ),
    "clf_gbt_exponential_rounds": (
        group_shares("GradientBoostingClassifier", {"n_estimators": 12, "max_depth": 5, "loss": "exponential"}, _is_high),
        EXPONENTIAL_ROUNDS_SQL,
    ),
    "clf_gbt_multiclass_rounds": (
        group_shares("GradientBoostingClassifier", {"n_estimators": 4, "max_depth": 5}, terciles, 3), _softmax_sql(0.1, 4)
    ),
    "reg_forest_groups": (
        group_tree("RandomForestRegressor", {"n_estimators": 5, "max_depth": 5, "bootstrap": False}), _group_sql("avg(y)")
    ),
    "clf_forest_groups": (
        group_tree(
            "RandomForestClassifier", {"n_estimators": 5, "max_depth": 5, "bootstrap": False, "max_features": None}, "hi"
        ),
        _group_sql("cast(avg(hi)>0.5 as int)::double"),
    ),
    "clf_tree_groups": (
        group_tree("DecisionTreeClassifier", {"max_depth": 5}, "hi"),
        _group_sql("cast(avg(hi)>0.5 as int)::double"),
    ),
    "reg_knn": (reg_knn, REG_KNN_SQL),
    "clf_knn": (clf_knn, CLF_KNN_SQL),
    "reg_random_forest": (fitted_predictions("RandomForestRegressor", "regression", {"n_estimators": 10, "max_depth": 8}), None),
    "reg_tree": (fitted_predictions("DecisionTreeRegressor", "regression", {"max_depth": 8}), None),
    "reg_gbt": (fitted_predictions("GradientBoostingRegressor", "regression", {"n_estimators": 10}), None),
    "reg_gbt_huber": (fitted_predictions("GradientBoostingRegressor", "regression", {"n_estimators": 5, "loss": "huber"}), None),
    "reg_gbt_quantile": (fitted_predictions("GradientBoostingRegressor", "regression", {"n_estimators": 5, "loss": "quantile"}), None),
    "reg_adaboost": (fitted_predictions("AdaBoostRegressor", "regression", {"n_estimators": 5}), None),
    "reg_xgb_hist": (fitted_predictions("XGBRegressor", "regression", {"n_estimators": 5, "max_depth": 4}), None),
    "reg_lasso": (fitted_predictions("Lasso", "regression", {"alpha": 0.01}), None),
    "reg_elastic_net": (fitted_predictions("ElasticNet", "regression", {"alpha": 0.01}), None),
    "reg_svr": (fitted_predictions("SVR", "regression"), None),
    "clf_logistic": (fitted_predictions("LogisticRegression", "classification"), None),
    "clf_tree": (fitted_predictions("DecisionTreeClassifier", "classification", {"max_depth": 8}), None),
    "clf_random_forest": (fitted_predictions("RandomForestClassifier", "classification", {"n_estimators": 10, "max_depth": 8}), None),
    "clf_gbt": (fitted_predictions("GradientBoostingClassifier", "classification", {"n_estimators": 10}), None),
    "clf_gbt_multiclass": (
        fitted_predictions("GradientBoostingClassifier", "classification", {"n_estimators": 3}, 3, terciles),
        None,
    ),
    "clf_gbt_exponential": (
        fitted_predictions("GradientBoostingClassifier", "classification", {"n_estimators": 3, "loss": "exponential"}),
        None,
    ),
    "clf_adaboost": (fitted_predictions("AdaBoostClassifier", "classification", {"n_estimators": 10}), None),
    "clf_xgb_hist": (fitted_predictions("XGBClassifier", "classification", {"n_estimators": 5, "max_depth": 4}), None),
    "clf_svc": (fitted_predictions("SVC", "classification"), None),
    "preprocessor_state": (preprocessor_state, _state_sql()),
    "model_save_load": (model_save_load, None),
    "leaderboard": (leaderboard, None),
    "random_search": (random_search_query, None),
    "learning_curve_accuracy": (learning_curve_accuracy, None),
    "learning_curve_r2": (learning_curve_r2, None),
    "feature_importance": (feature_importance, None),
    "train_end_to_end": (train_end_to_end, None),
    "score_batch": (score_batch, None),
    "report_text": (report_text, None),
}
