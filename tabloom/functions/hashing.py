"""Seeded hashes of a row key: the same number in Spark and in plain SQL engines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
HASH_SPACE = 1 << 32


def hash32(*key: Column | str, seed: int = SEED) -> Column:
    """First 32 bits of md5(seed|key...) as a BIGINT in [0, 2^32)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_column(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def u01(*key: Column | str, seed: int = SEED) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the key."""
    return hash32(*key, seed=seed).cast("double") / F.lit(float(HASH_SPACE))


def row_digest(columns: Iterable[str]) -> Column:
    """128-bit digest of a whole row; unique per row once duplicates are gone."""
    parts = []
    for name in columns:
        value = F.col(quoted(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.lit("v"), value), F.lit("n")))
    return F.md5(F.concat_ws("\x1f", *parts))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(key: Column | str) -> Column:
    return F.col(quoted(key)) if isinstance(key, str) else key
