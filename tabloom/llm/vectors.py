"""Columns of vectors: which are usable, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITE = float("inf")


def usable(vector: Column) -> Column:
    """True for a vector with entries, none of them null, NaN or infinite."""
    values = vector.cast("array<double>")
    odd = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INFINITE)))
    return F.coalesce((F.size(values) > 0) & ~odd, F.lit(False))


def common_width(df: DataFrame, vector: str) -> int:
    """The commonest length of a column of vectors, the larger one of a tie; 0 without rows."""
    sizes = df.groupBy(F.size(vector).alias("width")).count()
    found = sizes.orderBy(F.desc("count"), F.desc("width")).first()
    return int(found["width"]) if found else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of one width, in the type of its entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
