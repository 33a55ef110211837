"""Public model names and how each is fitted."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from .adaboost import fit_r2, fit_samme
from .base import FittedModel
from .boosting import fit_boosted
from .criterion_trees import fit_criterion_tree
from .kernels import fit_svc, fit_svr
from .linear import fit_nonnegative
from .native import fit_elastic, fit_forest, fit_gbt, fit_linear, fit_logistic, fit_ridge, fit_tree
from .neighbors import fit_neighbors
from .spaces import CLASSIFICATION_SPACES, REGRESSION_SPACES

REGRESSORS = list(REGRESSION_SPACES)
CLASSIFIERS = list(CLASSIFICATION_SPACES)
SPACES = {**REGRESSION_SPACES, **CLASSIFICATION_SPACES}


def model_names(task: str) -> list[str]:
    return REGRESSORS if task == "regression" else CLASSIFIERS


def fit_model(name: str, train: DataFrame, params: dict[str, Any] | None = None, classes: int = 2) -> FittedModel:
    """Fit a model by name on (row_key, label, features)."""
    p = dict(params or {})
    match name:
        case "RandomForestRegressor":
            return fit_forest(train, p, False)
        case "RandomForestClassifier":
            return fit_forest(train, p, True)
        case "DecisionTreeRegressor":
            if p.get("criterion") in ("absolute_error", "poisson"):
                return fit_criterion_tree(train, p, p["criterion"])
            return fit_tree(train, p, False)
        case "DecisionTreeClassifier":
            return fit_tree(train, p, True)
        case "GradientBoostingRegressor":
            loss = p.get("loss", "squared_error")
            if loss == "squared_error":
                return fit_gbt(train, p, False)
            return fit_boosted(train, {"max_depth": 3, **p}, loss)
        case "GradientBoostingClassifier":
            loss = p.get("loss", "log_loss")
            if loss == "log_loss" and classes == 2:
                return fit_gbt(train, p, True)
            kind = "softmax" if loss == "log_loss" else "exponential"
            if kind == "exponential" and classes > 2:
                raise ValueError("the exponential loss needs two classes")
            return fit_boosted(train, {"max_depth": 3, **p}, kind, classes)
        case "XGBRegressor":
            return fit_boosted(train, {**p, "order": 2}, "squared_error")
        case "XGBClassifier":
            return fit_boosted(train, {**p, "order": 2}, "logistic" if classes == 2 else "softmax", classes)
        case "AdaBoostRegressor":
            return fit_r2(train, p)
        case "AdaBoostClassifier":
            return fit_samme(train, p, classes)
        case "KNeighborsRegressor":
            return fit_neighbors(train, p, 0)
        case "KNeighborsClassifier":
            return fit_neighbors(train, p, classes)
        case "LinearRegression":
            return fit_nonnegative(train, p) if p.get("positive") else fit_linear(train, p)
        case "Ridge":
            return fit_ridge(train, p)
        case "Lasso":
            return fit_elastic(train, p, 1.0)
        case "ElasticNet":
            return fit_elastic(train, p, float(p.get("l1_ratio", 0.5)))
        case "SVR":
            return fit_svr(train, p)
        case "LogisticRegression":
            return fit_logistic(train, p)
        case "SVC":
            return fit_svc(train, p, classes)
    raise ValueError(f"unknown model {name}")
