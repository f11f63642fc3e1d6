"""Seal a stream: each micro-batch becomes one generation of a sealed table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnhelm.sources.sealed import write_sealed


def write_stream_sealed(stream: DataFrame, path: str, key: bytes, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Exactly once: a batch's generation is named by checkpoint and batch id, so one that is repeated after a failure isn't added twice."""
    of = hashlib.sha256(checkpoint.encode()).hexdigest()[:24]
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write_sealed(df, path, key, table, "append", generation=f"s{of}-{i}"))
    return (w.trigger(availableNow=True) if available_now else w).start()
