"""The three protection levels; a query returns the same rows at each."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame

from tarnhelm.plans.policy import KeyRegistry
from tarnhelm.session import scratch_path
from tarnhelm.sources.sealed import read_sealed, write_sealed


class Level(Enum):
    PLAIN = "plain"
    SEALED = "sealed"
    GOVERNED = "governed"

    def apply_to(self, df: DataFrame, table: str, key: bytes, at: str | None = None, budget: int = 50, columns: Sequence[str] | None = None) -> DataFrame:
        """Bring a frame to this level: plain as it is, else sealed and read back (under a token if governed).

        With ``columns`` only those are read back.
        """
        if self is Level.PLAIN:
            return df if columns is None else df.select(*[f"`{c}`" for c in columns])
        spark = df.sparkSession
        path = write_sealed(df, at or scratch_path(spark, f"sealed-{table}"), key, table, "overwrite")
        if self is Level.SEALED:
            return read_sealed(spark, path, key, table, columns)
        registry = KeyRegistry(key)
        return registry.open(registry.grant("reader", 1, budget)).scan(spark, path, table, columns).prepare_result()[0]
