"""Typed table registry and the loader for the driver's Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; projection and filters of the caller reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


@dataclass(frozen=True)
class Field:
    """One column of a registered table; every column may be null."""

    kind: str

    def spark(self) -> T.DataType:
        return _KINDS[self.kind]


_KINDS = {
    "string": T.StringType(), "text": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(),
}


class TableModel:
    """Subclass with ``Field`` attributes; the class registers itself under ``table``."""

    table: str = ""
    registry: dict[str, type[TableModel]] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls.table = cls.__dict__.get("table") or cls.__name__.lower()
        TableModel.registry[cls.table.lower()] = cls

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([T.StructField(k, f.spark(), True) for k, f in vars(cls).items() if isinstance(f, Field)])


class Rankings(TableModel):
    pageURL = Field("string")
    pageRank = Field("integer")
    avgDuration = Field("integer")


class UserVisits(TableModel):
    sourceIP = Field("string")
    destURL = Field("string")
    visitDate = Field("date")
    adRevenue = Field("float")
    userAgent = Field("string")
    countryCode = Field("string")
    languageCode = Field("string")
    searchWord = Field("string")
    duration = Field("integer")
