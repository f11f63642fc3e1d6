"""What the operators share: Arrow mapping in bounded slices, names, checkpoints, connected components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.session import scratch_path

SLICE_ROWS, SLICE_BYTES = 4096, 4 << 20


_KEPT: list = [None, {}]


def kept(owner: str) -> dict:
    """What a Python worker remembers between tasks for one operator; another operator's is let go first."""
    if _KEPT[0] != owner:
        _KEPT[:] = [owner, {}]
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: memory goes back when it likes
    return _KEPT[1]


def fresh(df: DataFrame | Iterable[str], base: str) -> str:
    """A column name that the frame doesn't have (names compare without case)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, what: str, compression: str = "zstd", into: Scratch | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives a lost executor."""
    at = scratch_path(df.sparkSession, what)
    if into is not None:
        into.paths.append(at)
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders through the file system that holds them."""
    for at in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one call; they go when its result is written or it fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
        return saved(df, what, compression, self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, *self.paths)
        self.paths.clear()


#: A key is heavy with more rows than total / HEAVY_KEYS, so there are at most that many.
HEAVY_KEYS, HEAVY_LEAST = 50_000, 256


def spread_join(rows: DataFrame, table: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key, ``size`` has how many of ``rows`` it meets), hot keys apart.

    Heavy keys are broadcast, HEAVY_KEYS of them at most by construction, and their rows stay
    where they are; every other key has too few rows to fill a task and is joined by shuffle.
    ``how`` is inner or left.  Columns: the keys, those of ``rows``, those of ``table``.  Both
    sides are read more than once: give written tables.
    """
    on = [on] if isinstance(on, str) else list(on)
    bound = max(HEAVY_LEAST, total // HEAVY_KEYS)
    heavy, light = table.filter(F.col(size) > bound), table.filter(F.col(size) <= bound)
    hot = rows.join(F.broadcast(heavy), on)
    rest = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how)
    return hot.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batch: pa.RecordBatch, weigh: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column ``weigh`` holds about SLICE_BYTES a slice (one longer text stays whole)."""
    if not batch.num_rows:
        return
    if weigh is None:
        cuts = list(range(0, batch.num_rows, SLICE_ROWS))
    else:
        col = batch.column(batch.schema.get_field_index(weigh))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64))
        total, cuts = 0.0, [0]
        for i, s in enumerate(sizes):
            if i > cuts[-1] and (total + s > SLICE_BYTES or i - cuts[-1] >= SLICE_ROWS):
                cuts.append(i)
                total = 0.0
            total += s
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def texts_of(col: pa.Array) -> list[str]:
    """Null is the empty text."""
    return [x or "" for x in col.to_pylist()]


_CUT, PIECE = re.compile(r"(?<=\w) (?=\w)"), 1 << 20


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces of about ``size`` characters.

    Cuts lie before a single space between word characters, where every word rule used here
    starts a new word, so the pieces' words are those of the text.
    """
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def add_columns(df: DataFrame, weigh: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """Append columns computed from column ``weigh``; columns of the same names are replaced.

    ``make`` runs once in each task and returns the function from a slice of the column to
    the new columns.  Every other column passes through as it is.
    """
    new = {f.name.lower() for f in fields}
    keep = [f.name for f in df.schema.fields if f.name.lower() not in new]
    source = df if weigh in keep else df.withColumn(weigh_in := fresh(df, f"_{weigh}_in"), F.col(weigh))
    name = weigh if weigh in keep else weigh_in
    schema = T.StructType([df.schema[k] for k in keep] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, name):
                at = part.schema.get_field_index
                yield pa.RecordBatch.from_arrays([*[part.column(at(k)) for k in keep], *f(part.column(at(name)))], names=schema.names)

    return source.select(*dict.fromkeys([*keep, name])).mapInArrow(run, schema)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a flat array as little-endian bytes; bounds has one entry more than there are rows."""
    width = values.dtype.itemsize
    offsets = (np.asarray(bounds, np.int64) * width)
    kind, off = (pa.binary(), offsets.astype(np.int32)) if offsets[-1] < 2**31 else (pa.large_binary(), offsets)
    out = pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    return out if kind == pa.binary() else out.cast(pa.binary())


def gather(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the given rows of a ragged table, and the bounds of the result's rows."""
    lens = bounds[rows + 1] - bounds[rows]
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return np.repeat(bounds[rows] - out[:-1], lens) + np.arange(out[-1]), out


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer, elementwise on uint64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, into: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the links; component is the smallest node reachable.

    Alternating large-star and small-star contraction: every round is two aggregations with
    partial minima and joins on the node, hubs apart; links stay distributed and each round is
    written to the shared folder.  The number of rounds grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    with Scratch(spark) as scratch:
        edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
        edges = scratch.saved(edges, "links")
        for _ in range(max_rounds):
            n = edges.count()
            if n == 0:
                break
            # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = scratch.saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least")
            large = spread_join(both, least, "u", "c", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = scratch.saved(large, "large")
            # small star: every smaller neighbour of u, and u, is linked to the smallest neighbour
            low = scratch.saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "low")
            small = spread_join(large, low, "u", "c", n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
            new = scratch.saved(small, "links")
            # at rest when every node points at its root and no root points further
            still = new.count() == n and new.join(edges, ["u", "v"], "left_anti").isEmpty()
            edges = new
            if still:
                break
        else:
            raise RuntimeError("components did not settle")
        own = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
        return saved(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own), "components", into=into)


def units(batches: Iterable[pa.RecordBatch], key: str = "unit") -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by ``key``, cut where it changes; one unit is held at a time."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.concat_batches([rest, b])
        if not b.num_rows:
            continue
        value = b.column(b.schema.get_field_index(key)).to_numpy()
        cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
        for a, z in zip([0, *cuts[:-1]], cuts):
            yield b.slice(a, z - a)
        rest = b.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def whole_units(batches: Iterable[pa.RecordBatch], key: str = "unit") -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by ``key``, cut so that no unit goes on in the next; many small units stay together."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.concat_batches([rest, b])
        if not b.num_rows:
            continue
        value = b.column(b.schema.get_field_index(key)).to_numpy()
        cut = int(np.searchsorted(value, value[-1]))
        if cut:
            yield b.slice(0, cut)
        rest = b.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest
