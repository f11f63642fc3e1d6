"""Session factory and the folder for data that must outlive an executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tarnhelm", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI SQL and adaptive execution; ``conf`` uses ``__`` for dots.

    Only a missing master is filled in, so ``spark-submit`` decides on a cluster.
    """
    b = SparkSession.builder.appName(app)
    if cores:
        b = b.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.redaction.string.regex": "(?i)unseal_key.*",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    In local mode an unset one becomes a temporary folder; on a cluster, where executors would
    each write to their own disk, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="tarnhelm-"))
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def force(df: DataFrame) -> None:
    """Run a plan and throw its rows away (for timing)."""
    df.write.format("noop").mode("overwrite").save()
