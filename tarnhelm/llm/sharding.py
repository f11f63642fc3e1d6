"""Operator 7: shards that all match the corpus mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded digest and ranked within their source.  A row's fractional
rank is (rank - 1/2) / rows of its source; in the order of fractional ranks every stretch
holds the sources in proportion, so equal cuts of it match the mixture.  Row counts of
shards differ by one at most (law ``rows``).

Ranks come from two range sorts and the counts of their partitions, never from a window
over a whole source, so a source with a third of all rows is spread like any other.

Defined results: a null source is a stratum of its own; repeated rows are sharded each,
equal ones next to each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.llm.common import partitions, saved


def seeded(seed: int, *cols: str) -> Column:
    """The shuffle key: hex of a digest of the seed and the columns."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def shard(df: DataFrame, n_shards: int, source: str = "source", by: Sequence[str] = ("doc_id", "text"), carry: dict[str, Column] | None = None, seed: int = 42) -> DataFrame:
    """The carried columns (default: all) with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``by`` identifies a row for the seeded shuffle.  Only carried columns are moved, so
    placements can be computed without moving texts.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    carry = carry or {c: F.col(c) for c in df.columns if c.lower() not in ("shard", "slot")}
    rows = df.select(F.struct(*[c.alias(k) for k, c in carry.items()]).alias("carry"), F.col(source).cast("string").alias("source"), seeded(seed, *by).alias("key"))
    # first sort: rank within the source
    first = saved(rows.repartitionByRange(n, F.col("source").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id()), "by-source")
    counts = first.groupBy("source", "part").agg(F.count("*").alias("rows"))
    per_source = Window.partitionBy("source").orderBy("part")
    before = counts.select(
        "source", "part",
        (F.sum("rows").over(per_source) - F.col("rows")).alias("before"),
        F.sum("rows").over(Window.partitionBy("source")).alias("total"),
    )
    here = Window.partitionBy("part", "source").orderBy("key")
    ranked = first.withColumn("here", F.row_number().over(here))
    same = ranked["source"].eqNullSafe(before["source"]) & (ranked["part"] == before["part"])
    frac = ranked.join(before, same).select("carry", ranked["source"], "key", ((F.col("before") + F.col("here") - F.lit(0.5)) / F.col("total")).alias("frac"))
    # second sort: by fractional rank; the order is total up to equal rows
    order = [F.col("frac"), F.col("source").asc_nulls_first(), F.col("key")]
    second = saved(frac.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "by-rank")
    sizes = {r["part"]: r["count"] for r in second.groupBy("part").count().collect()}
    total = sum(sizes.values())
    starts = accumulate([0, *[sizes[p] for p in sorted(sizes)]])
    offsets = spark.createDataFrame([(p, s) for p, s in zip(sorted(sizes), starts)], "part int, start bigint")
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = second.withColumn("local", local).join(F.broadcast(offsets), "part").withColumn("pos", F.col("start") + F.col("local") - 1)
    # shard s holds the positions from ceil(s * total / n) on
    which = F.floor(F.col("pos") * n_shards / F.lit(float(max(total, 1)))).cast("int")
    cut = F.array(*[F.lit(-(-s * total // n_shards)) for s in range(n_shards + 1)])
    exact = F.when(F.col("pos") < F.get(cut, which), which - 1).when(F.col("pos") >= F.get(cut, which + 1), which + 1).otherwise(which)
    return placed.withColumn("shard", exact).select("carry.*", "shard", (F.col("pos") - F.get(cut, F.col("shard"))).cast("bigint").alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int, **options) -> str:
    """Write the rows themselves, one folder a shard, each file in slot order."""
    shard(df, n_shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
