"""Vectors as rows: which take part, and moving them as little-endian doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, without null or non-finite components, and not zero."""
    d = v.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(d.isNotNull() & ~F.exists(d, bad) & F.exists(d, lambda x: x != 0), F.lit(False))


def dimension(df: DataFrame, v: str) -> int:
    """The commonest dimension (the smaller one on a tie); 0 if there are no vectors."""
    r = df.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return int(r[0]["d"]) if r else 0


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def sample(df: DataFrame, v: str, bound: int, key: str, seed: int = 0) -> np.ndarray:
    """At most ``bound`` vectors by the least hash of their key, on the driver."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(bound).select(v).toArrow()
    return matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.zeros((0, 0))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise inner products whose rounding depends on the two vectors alone (not on their place in a block)."""
    return np.add.reduce(np.ascontiguousarray(q * c), axis=-1)
