"""Operator 11, embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers floor(scale * c) + offset, so their sums S are exact, and centring
is n * x - S before anything is multiplied: a large common offset costs no digits. A pass over
the stored table gives V Q for the covariance V and a block Q of a few more columns than
components: each task multiplies its centred rows X as X^T (X Q), Spark adds up the small
results cell by cell, and the driver holds width x block numbers. V itself is never formed.

A few Lanczos steps bound the spectrum from below. Each sweep then applies a Chebyshev polynomial
(one pass a degree) that damps the interval from this bound to the block's smallest Ritz value,
makes the block orthonormal (QR) and solves the small projected problem (Rayleigh-Ritz). The
degree follows from the distance still to go. Sweeps end when the residual |V y - e y| of every
component is certified to be below `TOLERANCE` of the largest eigenvalue; where the wanted
values are too close to the rest to be told apart, the block is widened, up to the full width,
where the projection is exact.

The result is measured, not assumed: `identity_error` comes from a pass over the whitened rows.

Defined results: null vectors and vectors with null or non-finite entries, or of another length
than the commonest, are dropped, ids are only passed on (null, repeated); components of no
variance (below `RANK` of the largest) are left out, so equal rows or fewer than two of them give
no result; an empty table gives an empty result; other columns have no effect; a deviation
beyond 64 bits is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.shared import stored
from tabloom.llm.vectors import common_width, matrix, usable

COMPONENTS = 32
GUARD = 8
LANCZOS_STEPS = 10
MAX_DEGREE = 12
MAX_SWEEPS = 60
TOLERANCE, ACCEPTED = 1e-13, 1e-11
RANK = 1e-12
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centred:
    """The stored rows x, their number and exact sums, and sums over (x - S / n)."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width
        place = F.posexplode("x").alias("place", "value")
        sums = rows.select(place).groupBy("place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("s"))
        self.sums = [int(r["s"]) for r in sums.orderBy("place").collect()]
        self.n = rows.count()

    def total(self, make, size: int) -> np.ndarray:
        """The sum of make(centred rows), a vector of `size` doubles, over all rows."""
        n, sums, width = self.n, self.sums, self.width

        def run(batches):
            held = np.zeros(size)
            for batch in batches:
                held += make(centred(matrix(batch.column("x"), width), n, sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(held)], names=["cell", "value"])

        parts = self.rows.select("x").mapInArrow(run, "cell int, value double")
        cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(size)
        out[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
        return out

    def apply(self, block: np.ndarray) -> np.ndarray:
        """V Q in one pass."""
        return self.total(lambda c: (c.T @ (c @ block)).ravel(), block.size).reshape(block.shape) / self.n


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: 64 bits where they suffice, else Python integers."""
    top = max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(1, n) + 1)
    if top * n < 1 << 61:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return exact(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row the exact sum of squares of n * x - S; null beyond 64 bits."""
    whole = exact(x, n, sums)
    if whole.dtype != object and int(np.abs(whole).max(initial=0)) ** 2 * whole.shape[1] < 1 << 62:
        return (whole * whole).sum(1).tolist()
    whole = whole.astype(object)
    return [v if v < 1 << 63 else None for v in (whole * whole).sum(1).tolist()]


def lower_bound(apply, width: int, steps: int, rng) -> float:
    """A bound below the spectrum: the least Ritz value of a few Lanczos steps less its residual."""
    basis = [rng.standard_normal(width)]
    basis[0] /= np.linalg.norm(basis[0])
    diagonal, beside = [], []
    for _ in range(min(steps, width)):
        w = apply(basis[-1][:, None])[:, 0]
        diagonal.append(w @ basis[-1])
        known = np.array(basis).T
        for _ in range(2):
            w = w - known @ (known.T @ w)
        beside.append(np.linalg.norm(w))
        if beside[-1] <= 1e-12 * max(diagonal):
            beside[-1] = 0.0
            break
        basis.append(w / beside[-1])
    values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, values[0] - beside[-1] * abs(vectors[-1, 0]))


def _filtered(apply, block: np.ndarray, applied: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of V times the block; V times the block is known already."""
    centre, half = (high + low) / 2, (high - low) / 2
    ratio = first = half / (top - centre)
    before, now = block, (applied - centre * block) * (ratio / half)
    for _ in range(degree - 1):
        following = 1.0 / (2.0 / first - ratio)
        before, now = now, 2.0 * following / half * (apply(now) - centre * now) - ratio * following * before
        ratio = following
    return now


def leading(apply, width: int, components: int, guard: int = GUARD, seed: int = 11):
    """(eigenvalues, unit eigenvectors, passes), by falling eigenvalue, certified by residuals."""
    rng = np.random.default_rng(seed)
    wanted = min(components, width)
    passes = [0]

    def counted(q):
        passes[0] += 1
        return apply(q)

    block = np.linalg.qr(rng.standard_normal((width, min(width, wanted + guard))))[0]
    floor = lower_bound(counted, width, LANCZOS_STEPS, rng) if block.shape[1] < width else 0.0
    best = np.inf
    for _ in range(MAX_SWEEPS):
        applied = counted(block)
        small = block.T @ applied
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, applied = block @ turn, applied @ turn
        top = values[0]
        if top <= 0:
            return values[:0], block[:, :0], passes[0]
        residual = np.linalg.norm(applied - block * values, axis=0)[:wanted].max() / top
        if residual <= TOLERANCE or (residual <= ACCEPTED and residual > best / 2):
            return values[:wanted], block[:, :wanted], passes[0]
        if residual > best / 10 and block.shape[1] < width:  # too close to the rest: more columns
            more = rng.standard_normal((width, min(width - block.shape[1], block.shape[1])))
            block = np.linalg.qr(np.concatenate([block, more], axis=1))[0]
            best = np.inf
            continue
        best = min(best, residual)
        high = values[-1]
        if block.shape[1] == width or high - floor <= 1e-14 * top:
            block = np.linalg.qr(block)[0]
            continue
        away = 1.0 + 2.0 * (values[wanted - 1] - high) / (high - floor)
        growth = away + np.sqrt(max(away * away - 1.0, 0.0))
        degree = int(np.clip(np.ceil(np.log(residual / TOLERANCE * 10) / np.log(max(growth, 1.0 + 1e-9))), 2, MAX_DEGREE))
        block = np.linalg.qr(_filtered(counted, block, applied, degree, min(floor, high), high, top))[0]
    raise RuntimeError(f"components are not certified after {MAX_SWEEPS} sweeps (residual {residual:.1e} of the largest eigenvalue)")


def whiten(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: float = 64.0,
    offset: int = 1_000_000,
) -> DataFrame:
    """A row for each usable vector and component: its whitened coordinate, and how good the fit is."""
    spark = df.sparkSession
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(offset).cast("long"))
    rows = df.where(usable(F.col(vector))).select(F.col(id_col), x.alias("x"))
    width = common_width(rows, "x")
    rows = stored(rows.where(F.size("x") == width), "fit-list")
    kind = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    table = Centred(rows, width)
    n, sums = table.n, table.sums
    if n < 2:
        return spark.createDataFrame([], kind)
    values, vectors, _ = leading(table.apply, width, components)
    some = values > RANK * values.max(initial=0.0)
    values, vectors = values[some], vectors[:, some]
    count = len(values)
    if not count:
        return spark.createDataFrame([], kind)
    largest = vectors[np.abs(vectors).argmax(0), np.arange(count)]
    projection = vectors * np.sign(largest) / np.sqrt(values)

    def moments(c: np.ndarray) -> np.ndarray:
        w = c @ projection
        return np.concatenate([[(c * c).sum()], w.sum(0), (w.T @ w).ravel()])

    found = table.total(moments, 1 + count + count * count) / n
    mean = found[1 : 1 + count]
    error = float(np.abs(found[1 + count :].reshape(count, count) - np.outer(mean, mean) - np.eye(count)).max())
    explained = values / found[0]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                m = matrix(batch.column("x"), width)
                each = np.repeat(np.arange(len(m)), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(m))),
                        pa.array(np.full(len(each), n)),
                        pa.array(deviations(m, n, sums), pa.int64()).take(pa.array(each)),
                        pa.array((centred(m, n, sums) @ projection).ravel()),
                        pa.array(np.tile(explained, len(m))),
                        pa.array(np.full(len(each), error)),
                    ],
                    names=[id_col, *(part.split()[0] for part in SCHEMA.split(", "))],
                )

    return rows.mapInArrow(run, kind)
