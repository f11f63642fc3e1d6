"""Sealed tables: authenticated AES-GCM blocks in Parquet, with a sealed manifest.

Layout below ``path``::

    data/generation=G/   block_id LONG, num_rows INT, payload, payload_1, ... BINARY
    manifest/            generation STRING, body BINARY   (sealed JSON: schema, blocks, rows, replaces)

A payload is one column of a block as an Arrow IPC stream, so every Arrow-representable type
keeps its exact value and a reader that names its columns scans and opens only those.  The
additional authenticated data of a payload is its table, column, generation, block id and
row count: one that is altered, moved, relabelled or taken from another table fails to
open, and the manifest's counts expose blocks that were dropped or repeated.

A write commits with its manifest row, which also names the generations it replaces: a write
that dies before leaves the table as it was, and blocks of a generation without a manifest
row are not read.

The key reaches executors as a column of a one-row broadcast frame, which keeps it out
of plan texts.  It is not a defence against someone who reads executor memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BYTES = (16, 24, 32)
_LABELS = [T.StructField("block_id", T.LongType()), T.StructField("num_rows", T.IntegerType())]


class SealError(ValueError):
    """A sealed table is incomplete, was altered, or can't hold a type."""


def _payload(i: int) -> str:
    return f"payload_{i}" if i else "payload"


def _block(width: int) -> T.StructType:
    return T.StructType([*_LABELS, *[T.StructField(_payload(i), T.BinaryType()) for i in range(width)]])


def _check(schema: T.DataType) -> None:
    if isinstance(schema, (T.YearMonthIntervalType, T.CalendarIntervalType)):
        raise SealError(f"{schema.simpleString()} can't be sealed; store months and microseconds as numbers")
    for part in (getattr(schema, "fields", None) or ()):
        _check(part.dataType)
    for name in ("elementType", "keyType", "valueType"):
        if hasattr(schema, name):
            _check(getattr(schema, name))


def _stream(column: pa.Array, field: pa.Field) -> bytes:
    sink = pa.BufferOutputStream()
    one = pa.RecordBatch.from_arrays([column], schema=pa.schema([field]))
    with pa.ipc.new_stream(sink, one.schema) as w:
        w.write_batch(one)
    return sink.getvalue().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 32
    for i, b in enumerate(batches):
        if b.num_rows:
            payloads = [pa.array([_stream(c, f)], pa.binary()) for c, f in zip(b.columns, b.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + i], pa.int64()), pa.array([b.num_rows], pa.int32()), *payloads],
                names=["block_id", "num_rows", *map(_payload, range(len(payloads)))],
            )


def _unpack(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, n in enumerate(b.column(0).to_pylist()):
                columns = []
                for raw in b.columns[1:]:
                    with pa.ipc.open_stream(raw[i].as_buffer()) as r:
                        columns.append(r.read_next_batch().column(0))
                if any(len(c) != n for c in columns):
                    raise SealError(f"a block holds {[len(c) for c in columns]} rows, its label says {n}")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _keyed(spark: SparkSession, df: DataFrame, key: bytes) -> DataFrame:
    if len(key) not in KEY_BYTES:
        raise SealError("the key must have 16, 24 or 32 bytes")
    one = spark.createDataFrame([(bytearray(key),)], "unseal_key BINARY")
    return df.crossJoin(F.broadcast(one))


def _aad(table: str, *cols: str):
    return F.concat_ws("|", F.lit(table), *[F.col(c).cast("string") for c in cols])


def _seal(payload, table: str, *cols: str):
    return F.aes_encrypt(payload, F.col("unseal_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _aad(table, *cols))


def _open(payload, table: str, *cols: str, how=F.aes_decrypt):
    return how(payload, F.col("unseal_key"), F.lit("GCM"), F.lit("DEFAULT"), _aad(table, *cols))


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def seal_blocks(df: DataFrame, key: bytes, table: str, generation: str = "0") -> DataFrame:
    """The sealed blocks of a frame: generation, block_id, num_rows and one payload for each column."""
    _check(df.schema)
    if not df.columns:
        raise SealError("a frame without columns can't be sealed")
    width = len(df.columns)
    packed = df.mapInArrow(_pack, _block(width)).withColumn("generation", F.lit(generation))
    labels = ("generation", "block_id", "num_rows")
    return _keyed(df.sparkSession, packed, key).select(*labels, *[_seal(F.col(c), f"{table}#{i}", *labels).alias(c) for i, c in enumerate(map(_payload, range(width)))])


def _place(schema: T.StructType, column: str) -> int:
    """Where a column stands, by its exact name or else whatever the case."""
    exact = [i for i, n in enumerate(schema.names) if n == column]
    found = exact or [i for i, n in enumerate(schema.names) if n.lower() == column.lower()]
    if len(found) != 1:
        raise SealError(f"{'no' if not found else 'more than one'} column {column}")
    return found[0]


def unseal_blocks(blocks: DataFrame, key: bytes, table: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of sealed blocks, with ``columns`` (all: None) in that order; a wrong key, table or altered byte raises.

    Payloads of other columns are neither scanned nor opened.
    """
    wanted = list(range(len(schema))) if columns is None else [_place(schema, c) for c in columns]
    if not wanted:
        raise SealError("name at least one column")
    out = T.StructType([schema[i] for i in wanted])
    opened = _keyed(blocks.sparkSession, blocks, key).select(
        "num_rows", *[_open(F.col(_payload(i)), f"{table}#{i}", "generation", "block_id", "num_rows").alias(f"p{n}") for n, i in enumerate(wanted)]
    )
    return opened.mapInArrow(_unpack(out.names), out)


def write_sealed(df: DataFrame, path: str, key: bytes, table: str, mode: str = "error", partitions: int | None = None, generation: str | None = None) -> str:
    """Seal a frame below ``path``; ``mode`` is error, ignore, overwrite or append, and is honoured.

    Readers see the rows from the manifest's commit on; a replaced generation's blocks are
    deleted after it.  ``generation`` names the write: one that is already committed is not
    written again.
    """
    spark = df.sparkSession
    if mode not in ("error", "errorifexists", "ignore", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    known = _exists(spark, f"{path}/manifest")
    if mode in ("error", "errorifexists", "ignore") and known:
        if mode == "ignore":
            return path
        raise SealError(f"{path} already holds a sealed table")
    replaces: list[str] = []
    if known:
        replaces = [r["generation"] for r in spark.read.parquet(f"{path}/manifest").select("generation").distinct().collect()]
        if generation in replaces:
            return path
        if mode == "append":
            replaces = []
            if _manifest(spark, path, key, table)[0] != df.schema:
                raise SealError("the appended rows have another schema")
    generation = generation or f"g{uuid.uuid4().hex}"
    at = f"{path}/data/generation={generation}"
    seal_blocks(df.repartition(partitions) if partitions else df, key, table, generation).drop("generation").write.mode("overwrite").parquet(at)
    totals = spark.read.schema(T.StructType(_LABELS)).parquet(at).agg(F.count("*").alias("b"), F.sum("num_rows").alias("n")).first()
    body = json.dumps({"schema": df.schema.jsonValue(), "blocks": totals["b"], "rows": totals["n"] or 0, "replaces": replaces})
    one = spark.createDataFrame([(generation, bytearray(body.encode()))], "generation STRING, body BINARY").coalesce(1)
    _keyed(spark, one, key).select("generation", _seal(F.col("body"), f"{table}#manifest", "generation").alias("body")).write.mode("append").parquet(f"{path}/manifest")
    for old in replaces:
        _delete(spark, f"{path}/data/generation={old}")
    return path


def _manifest(spark: SparkSession, path: str, key: bytes, table: str) -> tuple[T.StructType, dict[str, dict]]:
    """Schema and manifest of the generations that count; replaced ones may be under another key."""
    sealed = _keyed(spark, spark.read.parquet(f"{path}/manifest"), key)
    rows = sealed.select("generation", _open(F.col("body"), f"{table}#manifest", "generation", how=F.try_aes_decrypt).alias("body")).collect()
    opened = [(r["generation"], r["body"] and json.loads(bytes(r["body"]).decode())) for r in rows]
    gone = {g for _, m in opened if m for g in m["replaces"]}
    parts = {g: m for g, m in opened if g not in gone}
    if not parts:
        raise SealError(f"{path} has no manifest")
    if not all(parts.values()):
        raise SealError("a manifest doesn't open: another key or table, or altered bytes")
    return T.StructType.fromJson(next(iter(parts.values()))["schema"]), parts


def read_sealed(spark: SparkSession, path: str, key: bytes, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of a sealed table, with ``columns`` only if they are named: the others are neither scanned nor opened.

    Block and row counts are checked first, on the narrow columns only.
    """
    schema, parts = _manifest(spark, path, key, table)
    layout = T.StructType([*_block(len(schema)).fields, T.StructField("generation", T.StringType())])
    if not _exists(spark, f"{path}/data"):
        raise SealError("blocks are missing or repeated")
    blocks = spark.read.schema(layout).parquet(f"{path}/data").filter(F.col("generation").isin(list(parts)))
    found = {
        r["generation"]: (r["b"], r["d"], r["n"])
        for r in blocks.groupBy("generation").agg(F.count("*").alias("b"), F.countDistinct("block_id").alias("d"), F.sum("num_rows").alias("n")).collect()
    }
    for g, m in parts.items():
        if found.get(g, (0, 0, 0)) != (m["blocks"], m["blocks"], m["rows"]):
            raise SealError("blocks are missing or repeated")
    return unseal_blocks(blocks, key, table, schema, columns)


def outsource(source: DataFrame | str, table: str, root: str, key: bytes, spark: SparkSession | None = None, schema: T.StructType | None = None, sep: str = ",", partitions: int | None = None, mode: str = "overwrite") -> str:
    """Owner's path: a frame or a delimited file becomes ``root/table``; sealed on the executors, returned by path."""
    if isinstance(source, str):
        from tarnhelm.sources.delimited import read_delimited

        source = read_delimited(spark, source, schema, sep)
    return write_sealed(source, f"{root.rstrip('/')}/{table}", key, table, mode, partitions)
