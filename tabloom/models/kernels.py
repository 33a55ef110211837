"""Support vector models on Nystrom kernel features (Williams and Seeger, 2001).

A sample of `n_landmarks` rows by hash (a parameter, 128 unless given) is the basis: the kernel
against them is mapped to plain features inside tasks, and a linear model is fitted on those, over
all rows. The error against the exact kernel falls as `n_landmarks` grows; with as many landmarks as
rows the kernel is exact.

The fit takes Newton steps on the hinge with a rounded corner, which is narrowed until it is sharp.
Only the plain features are stored: each pass maps them anew and brings the sums of all fits (classes
and left-out folds) at once, so its cost is a kernel row for each table row, and a fit needs tens of
passes. A linear kernel on more than `NEWTON_WIDTH` features is fitted by Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..functions.vectors import list_matrix, stack
from ..operators.encode import class_weights
from ..operators.split import stratified_folds
from ..session import compact, discard, materialize
from .base import FEATURES, KEY, LABEL, PREDICTION, SCORES, FittedModel, arg_best, as_array, register, width
from .linear import dot

LANDMARKS = 128
PLATT_FOLDS = 3
PARALLEL_FITS = 4
MAX_ITER, TOLERANCE = 200, 1e-6
NEWTON_WIDTH, HESSIAN_CELLS = 512, 1 << 21
CORNER, DAMPING = 5e-3, 1e-9
STEPS = np.array([0.0, 1.0, 0.5, 0.25, 0.125, 0.06, 0.03, 0.01, 0.003, 0.001])


def kernel(name: str, x: np.ndarray, y: np.ndarray, gamma: float, degree: int) -> np.ndarray:
    if name == "rbf":
        gap = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * x @ y.T
        return np.exp(-gamma * np.maximum(gap, 0.0))
    if name == "poly":
        return (gamma * x @ y.T) ** degree
    return np.tanh(gamma * x @ y.T)


@dataclass
class KernelMap:
    """phi(x) = k(x, landmarks) @ projection; the linear kernel keeps x itself."""

    name: str
    gamma: float = 1.0
    degree: int = 3
    landmarks: list = field(default_factory=list)
    projection: list = field(default_factory=list)

    def decisions(self, column: Column, weights: list[list[float]], intercepts: list[float]) -> Column:
        """An array with the value of each linear model on the mapped row."""
        if self.name == "linear":
            return F.array(*[dot(column, w) + F.lit(float(b)) for w, b in zip(weights, intercepts)])
        name, gamma, degree, points = self.name, self.gamma, self.degree, np.asarray(self.landmarks)
        folded, shift = np.asarray(self.projection) @ np.asarray(weights).T, np.asarray(intercepts)

        @F.pandas_udf("array<double>")
        def valued(x: pd.Series) -> pd.Series:
            return pd.Series(list(kernel(name, stack(x), points, gamma, degree) @ folded + shift))

        return valued(column)

    def raw(self):
        """The function from plain rows to kernel rows, and the matrix that makes those features."""
        if self.name == "linear":
            return lambda x: x, None
        name, gamma, degree, points = self.name, self.gamma, self.degree, np.asarray(self.landmarks)
        return lambda x: kernel(name, x, points, gamma, degree), np.asarray(self.projection)

    @classmethod
    def fit(cls, train: DataFrame, params: dict[str, Any]) -> "KernelMap":
        name = params.get("kernel", "rbf")
        if name == "linear":
            return cls(name)
        size, degree = width(train), int(params.get("degree", 3))
        gamma = params.get("gamma", "scale")
        if gamma == "scale":
            spread = train.select(F.explode(as_array()).alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (size * spread) if spread else 1.0
        elif gamma == "auto":
            gamma = 1.0 / size
        rows = train.select(as_array().alias("x"), hash32(KEY).alias("h"), KEY).orderBy("h", KEY)
        rows = rows.limit(int(params.get("n_landmarks", LANDMARKS))).collect()
        points = np.unique(np.array([r["x"] for r in rows]), axis=0)
        values, vectors = np.linalg.eigh(kernel(name, points, points, float(gamma), degree))
        good = values > 1e-9 * max(values.max(), 1e-12)
        projection = vectors[:, good] / np.sqrt(values[good])
        return cls(name, float(gamma), degree, points.tolist(), projection.tolist())


@dataclass
class Fit:
    """One hinge fit: a class against the rest (None: the tube around the label) without one fold."""

    target: int | None
    fold: int
    ridge: float
    corner: float
    theta: np.ndarray
    step: np.ndarray
    damping: float = DAMPING
    promised: float = 0.0
    aimed: bool = False


def _hinges(target: int | None, eps: float, label: np.ndarray) -> list[tuple[np.ndarray | float, np.ndarray | float]]:
    """(slope, offset) of the hinges max(0, offset - slope * value) of each row."""
    if target is None:
        return [(1.0, label - eps), (-1.0, -label - eps)]
    return [(np.where(label == target, 1.0, -1.0), 1.0)]


def _sums(rows: DataFrame, mapping: KernelMap, fits: list[Fit], eps: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each fit the loss at each of `STEPS`, and gradient and curvature of the loss after a whole step."""
    raw, projection = mapping.raw()
    size = len(fits[0].theta)
    upper = np.triu_indices(size)
    own = [(f.target, f.fold, f.corner) for f in fits]

    def folded(v: np.ndarray) -> np.ndarray:
        return v[:-1] if projection is None else projection @ v[:-1]

    at = np.array([folded(f.theta) for f in fits]).T
    along = np.array([folded(f.step) for f in fits]).T
    shift, turn = [float(f.theta[-1]) for f in fits], [float(f.step[-1]) for f in fits]
    steps = STEPS if any(f.step.any() for f in fits) else STEPS[:1]

    def partial(batches):
        loss = np.zeros((len(own), len(STEPS)))
        slope_sums = np.zeros((len(own), size))
        curves = np.zeros((len(own), size, size))
        for batch in batches:
            if not batch.num_rows:
                continue
            k = raw(list_matrix(batch.column(0)))
            label, weight, fold = (batch.column(i).to_numpy() for i in (1, 2, 3))
            values, moves = k @ at, k @ along
            for j, (target, left_out, corner) in enumerate(own):
                used = np.where(fold != left_out, weight, 0.0)
                value, move = values[:, j] + shift[j], moves[:, j] + turn[j]
                pull, bend = np.zeros(len(k)), np.zeros(len(k))
                for slope, offset in _hinges(target, eps, label):
                    for s, t in enumerate(steps):
                        gap = offset - slope * (value + t * move)
                        inside = np.clip(gap + corner, 0.0, 2.0 * corner)
                        loss[j, s] += used @ (inside * inside / (4.0 * corner) + np.maximum(gap - corner, 0.0))
                    gap = offset - slope * (value + move)
                    pull -= slope * used * np.clip((gap + corner) / (2.0 * corner), 0.0, 1.0)
                    bend += np.where(np.abs(gap) < corner, used / (2.0 * corner), 0.0)
                slopes = pull @ k
                slope_sums[j, :-1] += slopes if projection is None else slopes @ projection
                slope_sums[j, -1] += pull.sum()
                bent = np.flatnonzero(bend)
                z = k[bent] if projection is None else k[bent] @ projection
                z = np.column_stack([z, np.ones(len(bent))])
                curves[j] += z.T @ (z * bend[bent, None])
        values = np.concatenate([np.concatenate([loss[j], slope_sums[j], curves[j][upper]]) for j in range(len(own))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["i", "v"])

    cells = rows.select("x", LABEL, "weight", "fold").mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = cells.toPandas()
    width_each = len(STEPS) + size + len(upper[0])
    flat = np.zeros(len(fits) * width_each)
    flat[found["i"].to_numpy()] = found["v"].to_numpy()
    out = []
    for part in flat.reshape(len(fits), width_each):
        curve = np.zeros((size, size))
        curve[upper] = part[len(STEPS) + size :]
        out.append((part[: len(STEPS)], part[len(STEPS) : len(STEPS) + size], np.triu(curve) + np.triu(curve, 1).T))
    return out


def _newton(rows: DataFrame, mapping: KernelMap, fits: list[Fit], eps: float, sharp: float, tolerance: float, max_iter: int) -> None:
    """Bring all fits to the least ridge / 2 |w|^2 + sum of hinges, their corners narrowed to `sharp`.

    A fit ends when its next step promises less than `tolerance` of its cost.
    """
    together = max(1, min(16, HESSIAN_CELLS // len(fits[0].theta) ** 2))
    for start in range(0, len(fits), together):
        open_fits = fits[start : start + together]
        for _ in range(max_iter):
            sums = _sums(rows, mapping, open_fits, eps)
            open_fits = [f for f, found in zip(open_fits, sums) if not _advance(f, *found, sharp, tolerance)]
            if not open_fits:
                break


def _advance(fit: Fit, loss: np.ndarray, slope: np.ndarray, curve: np.ndarray, sharp: float, tolerance: float) -> bool:
    """Take the best step along the last direction and find the next; true if the fit has ended."""
    free = np.append(np.ones(len(slope) - 1), 0.0)
    here = loss[0] + 0.5 * fit.ridge * ((fit.theta * free) ** 2).sum()
    if fit.step.any():
        cost = loss + 0.5 * fit.ridge * (((fit.theta + STEPS[:, None] * fit.step) * free) ** 2).sum(1)
        gain = here - cost.min()
        if gain <= 0 or cost[1] > here - 0.3 * gain:
            # The whole step is not the one to take: its curvature is of no use.
            fit.theta, fit.step = fit.theta + STEPS[cost.argmin()] * fit.step, np.zeros_like(fit.step)
            if fit.aimed and gain <= 0:
                fit.damping = max(30.0 * fit.damping, 1e-4)
            settled = fit.aimed and gain <= tolerance * here and fit.promised <= 1e-4 * here
            return fit.corner <= sharp and (settled or fit.damping > 1e9)
        here, fit.theta = cost[1], fit.theta + fit.step
        fit.damping = max(0.1 * fit.damping, DAMPING)
    slope = slope + fit.ridge * free * fit.theta
    step = -np.linalg.solve(curve + np.diag(fit.ridge * free + fit.damping), slope)
    fit.promised = -0.5 * float(slope @ step)
    if fit.corner <= sharp and fit.promised <= tolerance * here:
        return True
    # A direction is aimed while the corner is the one it was found with.
    fit.aimed = fit.corner <= sharp or fit.promised > 0.01 * here
    if not fit.aimed:
        fit.corner = max(sharp, 0.3 * fit.corner)
    fit.step = step
    return False


@register("svr")
@dataclass
class SupportRegressor(FittedModel):
    mapping: KernelMap
    weights: list[float]
    intercept: float

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PREDICTION, self.mapping.decisions(as_array(), [self.weights], [self.intercept])[0])

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        return {"mapping": self.mapping.__dict__, "weights": self.weights, "intercept": self.intercept}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "SupportRegressor":
        return cls(KernelMap(**state["mapping"]), state["weights"], state["intercept"])


def fit_svr(train: DataFrame, params: dict[str, Any]) -> SupportRegressor:
    """The least 1/2 |w|^2 + C * sum of max(0, |residual| - epsilon)."""
    penalty, eps = float(params.get("C", 1.0)), float(params.get("epsilon", 0.1))
    mapping = KernelMap.fit(train, params)
    size = width(train) if mapping.name == "linear" else len(mapping.projection[0])
    if mapping.name == "linear" and size > NEWTON_WIDTH:
        return _wide_svr(train, mapping, penalty, eps, params)
    rows = train.select(as_array().alias("x"), LABEL, F.lit(penalty).alias("weight"), F.lit(0).alias("fold"))
    rows = compact(materialize(rows, "svr"))
    start = rows.agg(F.avg(LABEL).alias("mean"), F.stddev_pop(LABEL).alias("spread")).first()
    scale = float(start["spread"] or 1.0)
    theta = np.append(np.zeros(size), float(start["mean"]))
    fit = Fit(None, -1, 1.0, 4.0 * scale, theta, np.zeros(size + 1))
    sharp = min(0.01, CORNER * scale)
    _newton(rows, mapping, [fit], eps, sharp, float(params.get("tol", TOLERANCE)), int(params.get("max_iter", MAX_ITER)))
    discard(rows)
    return SupportRegressor(mapping, fit.theta[:-1].tolist(), float(fit.theta[-1]))


def _wide_svr(train: DataFrame, mapping: KernelMap, penalty: float, eps: float, params: dict[str, Any]) -> SupportRegressor:
    """Epsilon-insensitive fit of a wide linear model by iteratively reweighted least squares.

    Rounds end when the cost changes by less than `tol` of itself, or after `max_iter`.

    A residual r beyond epsilon costs C(|r| - eps); the quadratic with weight
    C/max(|r| - eps, small) has the same slope there, and rows inside weigh nothing.
    """
    phi = compact(materialize(train.select(LABEL, FEATURES), "svr"))
    start = phi.agg(F.avg(LABEL)).first()[0]
    size = width(phi)
    weights, intercept = [0.0] * size, float(start)
    best, last = (float("inf"), weights, intercept), float("inf")
    tolerance = float(params.get("tol", TOLERANCE))
    for _ in range(int(params.get("max_iter", MAX_ITER))):
        residual = F.col(LABEL) - dot(as_array(), weights) - F.lit(intercept)
        over = F.abs(residual) - F.lit(eps)
        # The smoothed corner keeps weights finite; the target is the point on the tube.
        weight = F.when(over > 0, F.lit(penalty) / F.greatest(over, F.lit(0.01))).otherwise(0.0)
        aimed = F.col(LABEL) - F.signum(residual) * F.lit(eps)
        rows = phi.select(FEATURES, aimed.alias(LABEL), weight.alias("weight"), F.when(over > 0, over).otherwise(0.0).alias("over"))
        sums = rows.agg(
            F.sum("over").alias("loss"),
            F.sum("weight").alias("w"),
            F.sum(F.col("weight") * F.col(LABEL)).alias("wy"),
            F.sum(F.col("weight") * F.col(LABEL) * F.col(LABEL)).alias("wyy"),
        ).first()
        cost = 0.5 * float(np.dot(weights, weights)) + penalty * sums["loss"]
        if cost < best[0] - 1e-9:
            best = (cost, weights, intercept)
        elif cost > best[0] * 1.05:
            break
        if abs(last - cost) <= tolerance * cost:
            break
        last = cost
        if sums["w"] <= 0:
            break
        spread = max(sums["wyy"] / sums["w"] - (sums["wy"] / sums["w"]) ** 2, 1e-12) ** 0.5
        model = LinearRegression(
            regParam=spread / sums["w"], elasticNetParam=0.0, standardization=False, weightCol="weight", solver="auto"
        ).fit(rows.where(F.col("weight") > 0))
        weights, intercept = model.coefficients.toArray().tolist(), float(model.intercept)
    discard(phi)
    return SupportRegressor(mapping, best[1], best[2])


@register("svc")
@dataclass
class SupportClassifier(FittedModel):
    """One margin per class (one for two classes), each with its Platt sigmoid."""

    mapping: KernelMap
    margins: list[dict[str, Any]]
    classes: int

    def predict(self, df: DataFrame) -> DataFrame:
        margins = self.mapping.decisions(as_array(), *zip(*[(m["weights"], m["intercept"]) for m in self.margins]))
        mapped = df.withColumn("__margins", margins)
        raw = []
        for c, m in enumerate(self.margins):
            margin = F.col("__margins")[c]
            raw.append(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(m["a"]) * margin + F.lit(m["b"])))))
        if self.classes == 2:
            scored = mapped.withColumn("__p", raw[0])
            scored = scored.withColumn(SCORES, F.array(F.lit(1.0) - F.col("__p"), F.col("__p")))
            return scored.withColumn(PREDICTION, (F.col("__margins")[0] > 0).cast("double")).drop("__margins", "__p")
        scored = mapped.withColumn("__raw", F.array(*raw))
        total = F.aggregate("__raw", F.lit(0.0), lambda t, x: t + x)
        scored = scored.withColumn(SCORES, F.transform("__raw", lambda x: x / F.greatest(total, F.lit(1e-300))))
        return scored.withColumn(PREDICTION, arg_best(F.col(SCORES))).drop("__margins", "__raw")

    def store(self, spark: SparkSession, path: str) -> dict[str, Any]:
        return {"mapping": self.mapping.__dict__, "margins": self.margins, "classes": self.classes}

    @classmethod
    def restore(cls, spark: SparkSession, path: str, state: dict[str, Any]) -> "SupportClassifier":
        return cls(KernelMap(**state["mapping"]), state["margins"], state["classes"])


def fit_svc(train: DataFrame, params: dict[str, Any], classes: int) -> SupportClassifier:
    """The least 1/(2 C n) |w|^2 + mean hinge for each class, with sigmoids from the folds' own margins."""
    mapping = KernelMap.fit(train, params)
    plain = train.select(KEY, LABEL, FEATURES)
    if params.get("class_weight") is None:
        plain = plain.withColumn("weight", F.lit(1.0))
    else:
        plain = class_weights(plain, LABEL, "weight")
    plain = stratified_folds(plain, LABEL, KEY, PLATT_FOLDS).select(as_array().alias("x"), LABEL, "weight", "fold")
    rows = compact(materialize(plain, "svc"))
    parts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    penalty, total = float(params.get("C", 1.0)), sum(r["n"] for r in parts)
    targets = [1] if classes == 2 else list(range(classes))
    # Independent fits: the whole table and one per left-out fold, for every class.
    jobs = [(c, fold) for c in targets for fold in range(-1, PLATT_FOLDS)]
    size = width(train) if mapping.name == "linear" else len(mapping.projection[0])
    if mapping.name == "linear" and size > NEWTON_WIDTH:
        found = _wide_svc(rows, jobs, penalty * total, params)
    else:
        fits = []
        for c, fold in jobs:
            ridge = sum(r["w"] for r in parts if r["fold"] != fold) / (penalty * total)
            fits.append(Fit(c, fold, ridge, 2.0, np.zeros(size + 1), np.zeros(size + 1)))
        tolerance, rounds = float(params.get("tol", TOLERANCE)), int(params.get("max_iter", MAX_ITER))
        _newton(rows, mapping, fits, 0.0, CORNER, tolerance, rounds)
        found = {(f.target, f.fold): (f.theta[:-1].tolist(), float(f.theta[-1])) for f in fits}
    # A row's margins come from the fits that have not seen it.
    held_out = None
    for fold in range(PLATT_FOLDS):
        values = mapping.decisions(F.col("x"), *zip(*[found[c, fold] for c in targets]))
        part = rows.where(F.col("fold") == fold).select(LABEL, values.alias("margins"))
        held_out = part if held_out is None else held_out.unionByName(part)
    held_out = compact(materialize(held_out, "margins"))
    margins = []
    for i, c in enumerate(targets):
        one = held_out.select((F.col(LABEL) == c).cast("double").alias(LABEL), array_to_vector(F.array(F.col("margins")[i])).alias(FEATURES))
        platt = LogisticRegression(maxIter=MAX_ITER).fit(one)
        weights, intercept = found[c, -1]
        margins.append({"weights": weights, "intercept": intercept, "a": float(platt.coefficients[0]), "b": float(platt.intercept)})
    discard(held_out)
    discard(rows)
    return SupportClassifier(mapping, margins, classes)


def _wide_svc(rows: DataFrame, jobs: list[tuple[int, int]], scale: float, params: dict[str, Any]) -> dict:
    """Weights and intercept of each linear fit, by Spark ML."""

    def fitted(job):
        c, fold = job
        own = rows.where(F.col("fold") != fold).select(
            (F.col(LABEL) == c).cast("double").alias(LABEL), "weight", array_to_vector("x").alias(FEATURES)
        )
        model = LinearSVC(
            regParam=1.0 / scale,
            standardization=False,
            weightCol="weight",
            maxIter=int(params.get("max_iter", MAX_ITER)),
            tol=float(params.get("tol", TOLERANCE)),
        ).fit(own)
        return model.coefficients.toArray().tolist(), float(model.intercept)

    with ThreadPool(PARALLEL_FITS) as pool:
        return dict(zip(jobs, pool.map(inheritable_thread_target(rows.sparkSession)(fitted), jobs)))
