"""Scan, aggregation and join queries over page rankings and user visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q1(rankings: DataFrame, above: int = 10) -> DataFrame:
    return rankings.filter(F.col("pageRank") > above).select("pageURL", "pageRank")


def q2(visits: DataFrame, prefix: int = 8) -> DataFrame:
    return visits.groupBy(F.substring("sourceIP", 1, prefix).alias("source")).agg(F.sum("adRevenue").alias("revenue"))


def q3(rankings: DataFrame, visits: DataFrame, lo, hi, by: str = "duration") -> DataFrame:
    """Visits whose ``by`` lies in [lo, hi], joined to the rank of the page, ordered by rank."""
    v = visits.filter(F.col(by).between(lo, hi)).select("sourceIP", "destURL", "adRevenue")
    j = rankings.select("pageURL", "pageRank").join(v, F.col("pageURL") == F.col("destURL"))
    return j.select("sourceIP", "pageRank", "adRevenue").orderBy("pageRank")


def probe(visits: DataFrame) -> DataFrame:
    """Operator probe: three columns of the visits in the order of revenue."""
    return visits.select("adRevenue", "destURL", "sourceIP").orderBy(F.col("adRevenue").asc())
