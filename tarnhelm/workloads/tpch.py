"""Product-type profit by nation and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def q9(part: DataFrame, supplier: DataFrame, lineitem: DataFrame, orders: DataFrame, nation: DataFrame, word: str, partsupp: DataFrame | None = None, min_quantity: float | None = None) -> DataFrame:
    """Profit of the parts whose name contains ``word``; without partsupp there is no supply cost."""
    li = lineitem if min_quantity is None else lineitem.filter(F.col("l_quantity") > min_quantity)
    j = li.join(part.filter(F.col("p_name").contains(word)), F.col("l_partkey") == F.col("p_partkey"))
    j = j.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    amount = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    if partsupp is not None:
        j = j.join(partsupp, (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_partkey") == F.col("l_partkey")))
        amount = amount - F.col("ps_supplycost") * F.col("l_quantity")
    j = j.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        j.select(F.col("n_name").alias("nation"), F.year("o_orderdate").alias("o_year"), amount.alias("amount"))
        .groupBy("nation", "o_year").agg(F.sum("amount").alias("sum_profit"))
    )
