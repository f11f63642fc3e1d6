"""The relational verbs, each a thin layer over one DataFrame call so that Catalyst sees everything.

Outer, semi, anti and cross joins, NULL groups, NULL-skipping aggregates, DISTINCT
aggregates and empty global aggregates all follow the SQL standard.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOINS = ("inner", "left", "right", "full", "left_semi", "left_anti", "cross")
AGGREGATES = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max,
    "first": F.first, "last": F.last, "count_distinct": F.countDistinct,
    "sum_distinct": F.sum_distinct,
}


def project(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.select(*[F.expr(c) if isinstance(c, str) else c for c in cols])


def where(df: DataFrame, cond: Column | str) -> DataFrame:
    return df.filter(cond)


def join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str] | None, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi-join by names or condition; ``residual`` is a further non-equi conjunct (condition form only)."""
    how = {"semi": "left_semi", "anti": "left_anti", "outer": "full"}.get(how, how)
    if how not in JOINS:
        raise ValueError(f"unknown join type {how!r}; one of {', '.join(JOINS)}")
    if how == "cross":
        return left.crossJoin(right)
    if residual is not None:
        if not isinstance(on, Column):
            raise ValueError("a residual condition needs the key condition as a Column")
        on = on & residual
    return left.join(right, on if isinstance(on, (Column, str)) else list(on or []), how)


def aggregate(df: DataFrame, keys: Iterable[Column | str], *aggs: Column, having: Column | str | None = None) -> DataFrame:
    """Group (or, without keys, aggregate the whole input to one row) and filter groups."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return out if having is None else out.filter(having)


def aggregate_by_name(df: DataFrame, group_col: str, agg_col: str, func: str) -> DataFrame:
    """``group_col``, ``func(agg_col)`` by the function's name, as the query service offers it."""
    if func not in AGGREGATES:
        raise ValueError(f"unknown aggregate {func!r}; one of {', '.join(AGGREGATES)}")
    return df.groupBy(group_col).agg(AGGREGATES[func](agg_col).alias(f"{func}({agg_col})"))


def distinct(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropDuplicates(list(cols)) if cols else df.distinct()


def sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """Total order through one range exchange."""
    return df.orderBy(*order)


def sort_within(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.sortWithinPartitions(*order)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Plans as TakeOrderedAndProject: k rows a task, no full sort."""
    return df.orderBy(*order).limit(k)


def union_all(*frames: DataFrame, by_name: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f) if by_name else out.union(f)
    return out


def union_distinct(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def persist(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Later plans that contain this one read the cached relation instead."""
    return df.persist(level)
