"""Small numpy helpers that run inside tasks on one Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa


def stack(column: pd.Series | np.ndarray) -> np.ndarray:
    """A batch of equally long arrays as a matrix of doubles."""
    if isinstance(column, np.ndarray) and column.ndim == 2:
        return column
    if len(column) == 0:
        return np.zeros((0, 0))
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def list_matrix(column: pa.ListArray) -> np.ndarray:
    """An Arrow column of equally long arrays as a matrix of doubles, without an object for each row."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _raised(gap: np.ndarray, p: float) -> np.ndarray:
    """|gap| to the power p, in place where that is a product."""
    if p == 2:
        return np.multiply(gap, gap, out=gap)
    np.abs(gap, out=gap)
    if p == 3:
        return gap * gap * gap
    return gap if p == 1 else gap**p


def _root(total: np.ndarray, p: float) -> np.ndarray:
    if p == 1:
        return total
    return np.sqrt(total) if p == 2 else total ** (1.0 / p)


def powers(left: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    """Distances to the power p between two small blocks, one coordinate at a time, in the precision of `left`."""
    total = np.zeros((len(left), len(right)), dtype=left.dtype)
    gap = np.empty_like(total)
    columns, rows = np.ascontiguousarray(right.T), np.ascontiguousarray(left.T)
    for j in range(len(columns)):
        total += _raised(np.subtract(rows[j][:, None], columns[j][None, :], out=gap), p)
    return total


def minkowski(left: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    """All distances between two small blocks."""
    return _root(powers(left, right, p), p)


def minkowski_pairs(left: np.ndarray, right: np.ndarray, p: float) -> np.ndarray:
    """The distance of each row of one block to the same row of the other; the numbers of `minkowski`."""
    total = np.zeros(len(left))
    for j in range(left.shape[1]):
        total += _raised(left[:, j] - right[:, j], p)
    return _root(total, p)
