"""Delimited text with a fixed, caller-supplied schema (no inference pass)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnhelm.catalog import TableModel


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | type[TableModel], sep: str = ",", strict: bool = True) -> DataFrame:
    """Comma, pipe (``.tbl``) or space separated files; ``strict`` fails on a malformed line."""
    if isinstance(schema, type):
        schema = schema.schema()
    return spark.read.schema(schema).option("sep", sep).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)


def from_rows(spark: SparkSession, rows, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.repartition(partitions) if partitions else df
