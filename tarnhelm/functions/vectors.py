"""Vector functions over ``array<double>`` as built-in higher-order expressions (no Python rows).

NULL in gives NULL out.  ``dot`` stops at the shorter vector, ``vector_add`` and
``vector_sum`` pad the shorter one with zeros, ``closest_point`` breaks ties towards
the lowest index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column | str, b: Column | str) -> Column:
    n = F.least(F.size(_c(a)), F.size(_c(b)))
    prods = F.zip_with(F.slice(_c(a), 1, n), F.slice(_c(b), 1, n), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def vector_add(a: Column | str, b: Column | str) -> Column:
    zero = F.lit(0.0)
    return F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x, zero) + F.coalesce(y, zero))


def vector_scale(v: Column | str, c: Column | float) -> Column:
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(_c(v), lambda x: x * c)


def squared_distance(a: Column | str, b: Column | str) -> Column:
    zero = F.lit(0.0)
    diff = F.zip_with(_c(a), _c(b), lambda x, y: F.coalesce(x, zero) - F.coalesce(y, zero))
    return F.aggregate(diff, zero, lambda acc, x: acc + x * x)


def _table(centroids: Sequence[Sequence[float]]) -> Column:
    return F.array(*[as_vector(c) for c in centroids])


def closest_index(p: Column | str, centroids: Sequence[Sequence[float]]) -> Column:
    """0-based index of the nearest centroid by squared L2.

    The centroids are one literal that an expression walks, so the plan doesn't grow with their number.
    """
    ranked = F.transform(_table(centroids), lambda c, i: F.struct(squared_distance(p, c).alias("d"), i.alias("i")))
    return F.when(_c(p).isNotNull(), F.array_min(ranked)["i"])


def closest_point(p: Column | str, centroids: Sequence[Sequence[float]]) -> Column:
    return F.when(_c(p).isNotNull(), F.get(_table(centroids), closest_index(p, centroids)))


def vector_sum(df: DataFrame, keys: Sequence[str], col: str, alias: str, dim: int | None = None) -> DataFrame:
    """Elementwise sum by group: one hash aggregation with partial sums.

    With ``dim`` the sum is ``dim`` plain sums in one aggregate (no row blow-up); a longer
    vector raises, shorter ones count as padded with zeros.  Without it ragged vectors are
    exploded by position.  Either way a group's sum is as long as its longest vector, and a
    group without components gives ``[]``.
    """
    if dim is not None:
        v = F.col(col)
        fits = F.when(F.coalesce(F.size(v), F.lit(0)) <= dim, v).otherwise(F.raise_error(F.lit(f"a vector has more than {dim} components")))
        sums = F.array(*[F.coalesce(F.sum(F.get(fits, F.lit(i))), F.lit(0.0)) for i in range(dim)])
        out = F.slice(sums, 1, F.greatest(F.coalesce(F.max(F.size(v)), F.lit(0)), F.lit(0))).alias(alias)
        return df.groupBy(*keys).agg(out) if keys else df.agg(out)
    slots = (
        df.select(*keys, F.posexplode_outer(col).alias("_pos", "_x"))
        .groupBy(*keys, "_pos").agg(F.sum("_x").alias("_x"))
    )
    packed = F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_x", F.lit(0.0)).alias("_x")))))
    return slots.groupBy(*keys).agg(F.transform(packed, lambda s: s["_x"]).alias(alias))
