"""Train on one table: clean, profile, split, encode, rebalance, fit, rank, tune, save."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import quoted, row_digest
from ..functions.nulls import null_tokens
from ..models.base import FEATURES, KEY, LABEL, SCORES, FittedModel, as_array
from ..models.registry import fit_model, model_names
from ..operators import curves as K
from ..operators import encode, leaderboard, profile
from ..operators.balance import rebalance
from ..operators.clean import Fills, canonical, drop_duplicates, fit_fills
from ..operators.split import random_holdout, stratified_holdout
from ..session import discard, materialize
from ..sources import artifacts as store
from ..sources import tables
from .evaluate import FOUR, evaluate, folded, in_threads, learning_curve, scored_rows
from .search import random_search

TARGET = "__target"


@dataclass
class Prepared:
    """Encoded rows (row_key, is_test, label, features) and what was fitted to get them."""

    data: DataFrame
    task: str
    classes: int
    encoded_target: bool
    band: str
    preprocessor: encode.Preprocessor
    fills: Fills
    labels: DataFrame | None
    kinds: dict[str, str]
    categorical: list[str]
    numeric: list[str]
    dropped: list[str]
    correlation: DataFrame
    warnings: list[str] = field(default_factory=list)

    @property
    def train(self) -> DataFrame:
        return self.data.where(~F.col("is_test")).select(KEY, LABEL, FEATURES)


@dataclass
class TrainResult:
    status: str
    report: dict[str, Any]
    leaderboard: DataFrame
    model: FittedModel
    prepared: Prepared
    curves: dict[str, DataFrame]
    path: str | None

    def __getitem__(self, name: str) -> Any:
        """`result["status"]`, or an entry of the report."""
        return self.status if name == "status" else self.report[name]

    def __contains__(self, name: str) -> bool:
        return name == "status" or name in self.report

    def artifacts(self) -> store.Artifacts:
        p = self.prepared
        return store.Artifacts(self.model, p.preprocessor, p.fills, p.kinds, p.labels if p.encoded_target else None)


def prepare(
    df: DataFrame,
    target: str,
    key: str | None = None,
    impute_scope: str = "all",
    approx: bool = False,
    coerce_numeric: bool = False,
    on_unseen: str = "error",
) -> Prepared:
    """Everything before the first model."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    blanked = null_tokens(canonical(df))
    if coerce_numeric:
        blanked = tables.retype_numbers(blanked)
    skip = (key,) if key else ()
    if impute_scope == "all":
        fills = fit_fills(blanked, approx, skip)
        cleaned = drop_duplicates(fills.apply(blanked), key)
    else:
        # Only the target is filled now; feature fills come from the training rows.
        own = fit_fills(blanked.select(quoted(target)), approx)
        cleaned = drop_duplicates(own.apply(blanked), key)
        fills = own
    if target in fills.empty:
        raise ValueError(f"column {target} has no value")
    row_key = F.col(quoted(key)).cast("string") if key else row_digest(cleaned.columns)
    cleaned = materialize(cleaned.withColumn(KEY, row_key), "cleaned")

    found = profile.profile(cleaned, target)
    labels, classes = None, 0
    if found.task == "classification":
        labels = encode.label_dictionary(cleaned, target)
        classes = labels.count()
        smallest = profile.class_counts(cleaned, target).agg(F.min("n")).first()[0]
        if smallest < 2:
            raise ValueError("a class has a single row and cannot be split")
        labelled = encode.encode_label(cleaned, labels, target, TARGET)
        held = stratified_holdout(labelled, TARGET, KEY)
    else:
        held = random_holdout(cleaned.withColumn(TARGET, F.col(quoted(target)).cast("double")), KEY)
    held = materialize(held, "held")
    train = held.where(~F.col("is_test"))

    if impute_scope != "all":
        rest = [c for c in blanked.columns if c not in (target, key)]
        more = fit_fills(train.select(*map(quoted, rest)), approx)
        fills = Fills({**fills.modes, **more.modes}, {**fills.medians, **more.medians}, more.empty)
        held = more.apply(held)
        train = held.where(~F.col("is_test"))

    categorical, numeric = profile.text_and_numeric(held, target, (KEY, TARGET, "is_test", *skip))
    correlation = profile.correlation_pairs(held, numeric)
    strong = profile.correlated_columns(profile.correlation_pairs(train, numeric)).collect()
    dropped = [c for c in numeric if c in {r[0] for r in strong}]
    numeric = [c for c in numeric if c not in dropped]
    kinds = {**dict.fromkeys(categorical, "categorical"), **dict.fromkeys(numeric, "numeric")}

    fitted = encode.Preprocessor.fit(train, categorical, numeric)
    rows = held.select(KEY, "is_test", F.col(TARGET).alias(LABEL), *map(quoted, fitted.inputs))
    data = materialize(fitted.transform(rows, [KEY, "is_test", LABEL], on_unseen), "encoded")
    warnings = [f"column {c} has no value and was dropped" for c in fills.empty]
    if found.task == "classification":
        if found.band == "none":
            warnings.append(f"imbalance ratio {found.ratio:.1f} is beyond the resampling bands")
        else:
            x = data.where(~F.col("is_test")).select(KEY, LABEL, FEATURES)
            # Only new rows need their features as arrays.
            grown = found.band == "moderate"
            balanced = rebalance(x.withColumn(FEATURES, as_array()) if grown else x, LABEL, KEY, FEATURES, found.band)
            features = array_to_vector(FEATURES) if grown else F.col(FEATURES)
            balanced = balanced.select(KEY, F.lit(False).alias("is_test"), LABEL, features.alias(FEATURES))
            data = materialize(balanced.unionByName(data.where("is_test")), "balanced")
    return Prepared(
        data, found.task, classes, found.encode, found.band, fitted, fills, labels, kinds,
        categorical, numeric, dropped, correlation, warnings,
    )


METRICS = {
    "regression": [f"{p}_{m}" for p in ("train", "test") for m in ("rmse", "r2")],
    "classification": [f"{p}_{m}" for p in ("train", "test") for m in (*FOUR, "rocauc_score")],
}


def fit_all(
    prepared: Prepared, jobs: list[tuple[str, dict[str, Any]]], tuned: bool, parallelism: int
) -> tuple[DataFrame, dict[str, FittedModel], dict[str, DataFrame]]:
    """Fit and evaluate the named models: (leaderboard rows, models, scored rows)."""
    spark = prepared.data.sparkSession
    train = prepared.train

    def run(job):
        name, params = job
        model = fit_model(name, train, params, prepared.classes)
        scored = scored_rows(model, prepared.data)
        return name, params, model, scored, evaluate(scored, prepared.task, prepared.classes)

    done = in_threads(spark, run, jobs, parallelism)
    names = METRICS[prepared.task]
    rows = [
        (name, tuned, {k: str(v) for k, v in params.items()}, *[found.get(m) for m in names])
        for name, params, _, _, found in done
    ]
    schema = "model string, tuned boolean, params map<string,string>, " + ", ".join(f"{m} double" for m in names)
    return (
        spark.createDataFrame(rows, schema),
        {d[0]: d[2] for d in done},
        {d[0]: d[3] for d in done},
    )


def train(
    data: DataFrame | str,
    target: str,
    rmse_weight: float = 0.5,
    f1_weight: float = 0.5,
    key: str | None = None,
    n_iter: int = 100,
    n_splits: int = 5,
    parallelism: int = 4,
    out: str | None = None,
    fast: bool = False,
    models: list[str] | None = None,
    params: dict[str, dict[str, Any]] | None = None,
    seed: int = 42,
    refit: str = "winner",
    curves: bool = True,
    impute_scope: str = "all",
    approx: bool = False,
    coerce_numeric: bool = False,
    on_unseen: str = "error",
    multi_line: bool = False,
    spark: SparkSession | None = None,
) -> TrainResult:
    """Find and fit the best model for a table.

    `rmse_weight` and `f1_weight` weigh RMSE against R2 and F1 against accuracy in the
    ranking. `params` sets parameters per model for all of its fits. `refit="winner"`
    keeps the row that won; `"tuned"` keeps its tuned form whatever row won (the two differ only
    where the untuned row ranked first).
    """
    spark = spark or (data.sparkSession if isinstance(data, DataFrame) else SparkSession.active())
    df = materialize(tables.read_table(spark, data, multi_line=multi_line), "input") if isinstance(data, str) else data
    prepared = prepare(df, target, key, impute_scope, approx, coerce_numeric, on_unseen)
    task, weight = prepared.task, rmse_weight if prepared.task == "regression" else f1_weight
    params = params or {}
    names = [m for m in model_names(task) if models is None or m in models]

    first, fitted, scored = fit_all(prepared, [(n, params.get(n, {})) for n in names], False, parallelism)
    top = leaderboard.rank_models(first, task, weight)
    top_names = [r["model"] for r in top.collect()]

    n_iter = n_iter // 2 if fast else n_iter
    best_params, trials = {}, None
    # All searches judge by the same folds, placed and stored once.
    folds = folded(prepared.train, task, n_splits)
    for name in top_names:
        found, table = random_search(
            prepared.train, name, task, prepared.classes, None, n_iter, n_splits, parallelism, seed, params.get(name), folds=folds
        )
        best_params[name] = {**found, **params.get(name, {})}
        trials = table if trials is None else trials.unionByName(table)
    discard(folds)
    second, tuned_models, tuned_scored = fit_all(prepared, [(n, best_params[n]) for n in top_names], True, parallelism)

    board = leaderboard.rerank(top, second, task, weight, None)
    winner = board.first()
    name, was_tuned = winner["model"], winner["tuned"]
    keep_tuned = was_tuned or refit == "tuned"
    model = (tuned_models if keep_tuned else fitted)[name]
    final_params = best_params[name] if keep_tuned else params.get(name, {})
    final_scored = (tuned_scored if keep_tuned else scored)[name]

    report = build_report(prepared, target, winner.asDict(), best_params.get(name, {}))
    tables_out: dict[str, DataFrame] = {}
    if curves:
        tables_out = diagnostics(prepared, model, name, final_params, final_scored, parallelism)
        if trials is not None:
            tables_out["search"] = trials
    path = f"{out.rstrip('/')}/artifacts" if out else None
    if path:
        model.save(spark, f"{path}/model")
        store.save_preprocessor(spark, path, prepared.preprocessor, prepared.fills, prepared.kinds)
        if prepared.labels is not None and prepared.encoded_target:
            store.save_labels(prepared.labels, path)
        store.save_report(spark, path, report)
        store.save_curves({**tables_out, "leaderboard": board}, path)
    return TrainResult("success", report, board, model, prepared, tables_out, path)


def build_report(prepared: Prepared, target: str, winner: dict[str, Any], best_params: dict[str, Any]) -> dict[str, Any]:
    report = {
        "message": "Training completed successfully",
        "problem_type": prepared.task,
        "model": winner["model"],
        "output_feature": target,
        "categorical_features": prepared.categorical,
        "numerical_features": prepared.numeric,
        **{m: None if winner[m] is None else round(winner[m], 4) for m in METRICS[prepared.task]},
        "hyper_tuned": winner["tuned"],
        "dropped_columns": prepared.dropped,
        "encoded_target": prepared.encoded_target,
    }
    if winner["tuned"]:
        report["best_params"] = best_params
    warnings = prepared.warnings + ([winner["warning"]] if winner.get("warning") else [])
    if warnings:
        report["warnings"] = warnings
    return report


def diagnostics(
    prepared: Prepared, model: FittedModel, name: str, params: dict[str, Any], scored: DataFrame, parallelism: int
) -> dict[str, DataFrame]:
    """The tables behind the diagnostic plots of the winner."""
    test = scored.where("is_test")
    found: dict[str, DataFrame] = {"correlation": prepared.correlation}
    if prepared.task == "regression":
        found["actual_vs_predicted"] = K.actual_vs_predicted(test)
        found["residuals"] = K.residuals(test)
        found["residual_histogram"] = K.residual_histogram(test)
        found["residual_kde"] = K.residual_kde(test)
        found["learning_curve"] = learning_curve(name, params, prepared.train, prepared.task, 0, 5, parallelism)
    else:
        found["confusion_matrix"] = K.confusion_matrix(test)
        found["class_distribution"] = K.class_distribution(scored, LABEL)
        if prepared.classes == 2:
            binary = test.withColumn("score", F.col(SCORES)[1])
            found["roc"] = K.roc_points(binary)
            found["precision_recall"] = K.pr_points(binary)
        smallest = profile.class_counts(prepared.train, LABEL).agg(F.min("n")).first()[0]
        folds = min(5, smallest)
        if folds >= 2:
            found["learning_curve"] = learning_curve(
                name, params, prepared.train, prepared.task, prepared.classes, folds, parallelism
            )
    shares = feature_importance(prepared, model)
    if shares is not None:
        found["feature_importance"] = shares
    return found


def feature_importance(prepared: Prepared, model: FittedModel) -> DataFrame | None:
    """(feature, importance, percent), for models that have importances."""
    values = model.importances
    if values is None:
        return None
    spark = prepared.data.sparkSession
    rows = [(n, float(v)) for n, v in zip(prepared.preprocessor.display_names, values)]
    return K.importance_shares(spark.createDataFrame(rows, "feature string, importance double"))
