"""PageRank, k-means, logistic regression and least squares.

Each pass is one aggregation with partial sums; the driver keeps only the model (ranks stay
distributed).  Inputs are persisted for the loop and released after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.functions.scalars import sigmoid
from tarnhelm.functions.vectors import as_vector, closest_index, dot
from tarnhelm.session import shared_dir


def out_links(edges: DataFrame) -> DataFrame:
    """src, dst and the number of edges that leave src; degrees combine before they move."""
    return edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree")


def _spread(links: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    share = links.join(ranks, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("s"))
    return share.select(F.col("dst").alias("id"), (F.lit(1 - damping) + damping * F.col("s")).alias("rank"))


def pagerank_step(edges: DataFrame, ranks: DataFrame, damping: float = 0.85) -> DataFrame:
    """edges(src, dst), ranks(id, rank) -> ranks of the nodes that are pointed at."""
    return _spread(out_links(edges), ranks, damping)


def pagerank(edges: DataFrame, steps: int = 5, damping: float = 0.85) -> DataFrame:
    """Degrees are counted once; lineage is cut after each step by a checkpoint in the shared folder."""
    shared_dir(edges.sparkSession)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().persist()
    links = out_links(edges).persist()
    try:
        ranks = nodes.withColumn("rank", F.lit(1.0))
        for _ in range(steps):
            new = _spread(links, ranks, damping)
            ranks = nodes.join(new, "id", "left").select("id", F.coalesce("rank", F.lit(1 - damping)).alias("rank")).checkpoint()
        return ranks
    finally:
        links.unpersist()
        nodes.unpersist()


def kmeans_step(points: DataFrame, col: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """cluster, n and the mean vector; a centroid without points has no row."""
    dim = len(centroids[0])
    sums = [F.sum(F.get(F.col(col), F.lit(i))).alias(f"_{i}") for i in range(dim)]
    g = points.filter(F.col(col).isNotNull()).groupBy(closest_index(col, centroids).alias("cluster")).agg(F.count("*").alias("n"), *sums)
    return g.select("cluster", "n", F.array(*[F.col(f"_{i}") / F.col("n") for i in range(dim)]).alias("center"))


def kmeans(points: DataFrame, col: str, centroids: Sequence[Sequence[float]], eps: float = 1e-4, max_steps: int = 50) -> list[list[float]]:
    """Lloyd's iteration until the summed squared movement is at most ``eps``; dead clusters drop out."""
    points, centers = points.select(col).persist(), [list(map(float, c)) for c in centroids]
    try:
        for _ in range(max_steps):
            new = {r["cluster"]: list(r["center"]) for r in kmeans_step(points, col, centers).collect()}
            moved = sum((a - b) ** 2 for i, c in new.items() for a, b in zip(c, centers[i], strict=True))
            centers = [new[i] for i in sorted(new)]
            if moved <= eps:
                break
        return centers
    finally:
        points.unpersist()


def logistic_gradient(points: DataFrame, x: str, y: str, w: Sequence[float]) -> DataFrame:
    """One row: the full-batch gradient of the logistic loss, labels in {-1, 1}."""
    scale = (sigmoid(F.col(y) * dot(x, as_vector(w))) - 1.0) * F.col(y)
    return points.select(x, scale.alias("_s")).agg(F.array(*[F.sum(F.get(F.col(x), F.lit(i)) * F.col("_s")) for i in range(len(w))]).alias("gradient"))


def logistic_regression(points: DataFrame, x: str, y: str, dim: int, steps: int = 5, rate: float = 1.0, start: Sequence[float] | None = None) -> list[float]:
    points, w = points.select(x, y).persist(), list(start or [0.0] * dim)
    try:
        for _ in range(steps):
            g = logistic_gradient(points, x, y, w).first()["gradient"]
            w = [a - rate * (b or 0.0) for a, b in zip(w, g, strict=True)]
        return w
    finally:
        points.unpersist()


def least_squares_moments(df: DataFrame, x1: str = "x1", x2: str = "x2", y: str = "y") -> DataFrame:
    """The five product sums of the normal equations, in one pass."""
    a, b, c = F.col(x1), F.col(x2), F.col(y)
    return df.agg(F.sum(a * a).alias("s11"), F.sum(a * b).alias("s12"), F.sum(b * b).alias("s22"), F.sum(a * c).alias("s1y"), F.sum(b * c).alias("s2y"))


def least_squares(df: DataFrame, x1: str = "x1", x2: str = "x2", y: str = "y") -> tuple[float, float]:
    m = least_squares_moments(df, x1, x2, y).first()
    det = m["s11"] * m["s22"] - m["s12"] ** 2
    return ((m["s22"] * m["s1y"] - m["s12"] * m["s2y"]) / det, (m["s11"] * m["s2y"] - m["s12"] * m["s1y"]) / det)
