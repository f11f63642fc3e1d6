"""Operator 2: token ids in directly addressable codes.

A segment splits every id into chunks of eight bits, lowest first, one level a chunk.  A
level has a chunk for each id that reaches it and a bitmap that says which of them go on
to the next level; a directory counts the set bits before each block of 512.  The id at
any place is found by one rank lookup a level, without decoding its neighbours, and a run
of ids is a contiguous run on every level.

Segment layout (little-endian)::

    magic "DAC1", u32 documents, u64 ids, u32 levels
    i64 doc_id[documents], u8 doc_id_is_null[documents], u64 start[documents + 1]
    per level: u64 n, u8 chunk[n], u8 bitmap[ceil(n / 8)], u32 rank[ceil(n / 512) + 1]

Documents are written in ascending doc_id order (null first; repeated ids by text), each
whole in one segment.  A store is a folder with ``segments`` (part, segment, before: ids
of the part before it, documents, ids, payload) and ``parts`` (part, start: ids before the
part), so any document's place in the whole sequence is known without a scan.

``lookup`` reads ids at places of the whole sequence and ``documents_at`` whole documents:
the narrow columns say which segments hold them, only those payloads are fetched, and
single ids are decoded by rank, not by reading a segment through.

Defined results: a null or empty text is stored with the end id only; repeated rows are
stored each; an empty table gives a store without segments; other columns are ignored;
texts of any length are encoded whole, in pieces, and stay in one segment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm.bpe import encoder_of
from tarnhelm.llm.common import binary_rows, partitions, slices, texts_of

SEGMENT_IDS = 1 << 20
_BLOCK = 512
_SEGMENTS = "part int, segment int, before bigint, documents int, ids bigint, payload binary"


def pack_ids(ids: np.ndarray) -> bytes:
    """The levels of one run of ids."""
    rest, out = ids.astype(np.uint32), []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        rank = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        out.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        if not more.any():
            return struct.pack("<I", len(out)) + b"".join(out)
        rest = rest[more] >> 8


def pack_segment(doc_ids: Sequence[int | None], bounds: np.ndarray, ids: np.ndarray) -> bytes:
    n = len(doc_ids)
    return b"".join([
        b"DAC1", struct.pack("<IQ", n, len(ids)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(), np.asarray(bounds, "<u8").tobytes(), pack_ids(ids),
    ])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a segment")
        n, self.n_ids = struct.unpack_from("<IQ", raw, 4)
        at = 16
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.nulls = np.frombuffer(raw, "u1", n, at + 8 * n).astype(bool)
        self.bounds = np.frombuffer(raw, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        (levels,) = struct.unpack_from("<I", raw, at)
        at += 4
        self.levels = []
        for _ in range(levels):
            (k,) = struct.unpack_from("<Q", raw, at)
            chunk = np.frombuffer(raw, "u1", k, at + 8)
            at += 8 + k
            bits = np.frombuffer(raw, "u1", -(-k // 8), at)
            at += len(bits)
            rank = np.frombuffer(raw, "<u4", -(-k // _BLOCK) + 1, at)
            at += 4 * len(rank)
            self.levels.append((chunk, bits, rank))

    @staticmethod
    def _rank(bits: np.ndarray, rank: np.ndarray, i: int) -> int:
        """Set bits before place i."""
        b = i // _BLOCK
        tail = bits[b * _BLOCK // 8 : i // 8]
        n = int(rank[b]) + int(np.bitwise_count(tail).sum())
        return n + (int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for chunk, bits, rank in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, rank, i), shift + 8
        return value

    def run(self, a: int, b: int) -> np.ndarray:
        """Ids at places a to b (b excluded)."""
        out = np.zeros(b - a, np.uint32)
        where = np.arange(b - a)
        for level, (chunk, bits, rank) in enumerate(self.levels):
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            first = a - a % 8
            more = np.unpackbits(bits[first // 8 : -(-b // 8)], bitorder="little")[a - first : b - first].astype(bool)
            where = where[more]
            if not len(where):
                break
            a = self._rank(bits, rank, a)
            b = a + len(where)
        return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> str:
    """Encode and store every text, each followed by ``end_id``, in doc_id order; one shuffle of the texts."""
    spark = docs.sparkSession
    n = parts or partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        names: list = []
        flats: list[np.ndarray] = []
        lens: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, before
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
            ids = np.concatenate(flats)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([len(names)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pack_segment(names, bounds, ids)], pa.binary())],
                names=["part", "segment", "before", "documents", "ids", "payload"],
            )
            segment, before = segment + 1, before + len(ids)
            names.clear(), flats.clear(), lens.clear()
            return row

        for batch in batches:
            for piece in slices(batch, "text"):
                flat, bounds = encoder.encode(texts_of(piece.column(1)))
                names += piece.column(0).to_pylist()
                flats.append(np.insert(flat, bounds[1:], end_id))
                lens.append(np.diff(bounds) + 1)
                if sum(map(len, flats)) >= SEGMENT_IDS:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, _SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    # one total a range of documents: as many rows as partitions
    totals = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()
    starts = accumulate([0, *[r["n"] for r in totals]])
    spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts)], "part int, start bigint").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32)."""
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    # a row for each partition that was written: small by construction
    parts = F.broadcast(spark.read.schema("part int, start bigint").parquet(f"{path}/parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start in zip(batch.column(0), batch.column(1).to_pylist()):
                s = Segment(raw.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64(), mask=s.nulls), pa.array(s.bounds[:-1] + start, pa.int64()), pa.array(np.diff(s.bounds), pa.int64()), binary_rows(s.run(0, s.n_ids).astype("<u4"), s.bounds)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.join(parts, "part").select("payload", (F.col("start") + F.col("before")).alias("start")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _located(spark: SparkSession, path: str, places: DataFrame, place: str) -> DataFrame:
    """part, segment, first (the segment's first place), place, payload: each distinct place with its segment, together.

    A place meets its segment by a range join on blocks of SEGMENT_IDS places, which shuffles
    places and segment numbers only; then the segments asked for come with their payloads.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    parts = F.broadcast(spark.read.schema("part int, start bigint").parquet(f"{path}/parts"))
    spans = segments.filter("ids > 0").join(parts, "part").select("part", "segment", (F.col("start") + F.col("before")).alias("first"), "ids")
    spans = spans.withColumn("block", F.explode(F.sequence(F.expr(f"first div {SEGMENT_IDS}"), F.expr(f"(first + ids - 1) div {SEGMENT_IDS}"))))
    wanted = places.select(F.col(place).cast("bigint").alias("place")).filter("place >= 0").distinct().withColumn("block", F.expr(f"place div {SEGMENT_IDS}"))
    hits = wanted.join(spans, "block").filter("place >= first AND place < first + ids").select("part", "segment", "first", "place")
    met = hits.join(segments.select("part", "segment", "payload"), ["part", "segment"]).sortWithinPartitions("part", "segment")
    return met.select("part", "segment", "first", "place", "payload")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Segment, int, int]]:
    """(segment, place, place in the segment) of located rows; a segment is opened once for rows that come together."""
    last: tuple = (None, None)
    for batch in batches:
        part, segment, first, at = (batch.column(i).to_pylist() for i in range(4))
        for i in range(batch.num_rows):
            if last[0] != (part[i], segment[i]):
                last = ((part[i], segment[i]), Segment(batch.column(4)[i].as_py()))
            yield last[1], at[i], at[i] - first[i]


def lookup(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """(place, id) for every distinct place of the whole sequence that is asked for; places beyond it have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((at, s[where]) for s, at, where in _opened(batches))
        while some := list(islice(rows, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some)], names=["place", "id"])

    return _located(spark, path, places, place).mapInArrow(run, "place bigint, id bigint")


def documents_at(spark: SparkSession, path: str, starts: DataFrame, start: str = "start") -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents that begin at the given places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, at, where in _opened(batches):
            d = int(np.searchsorted(s.bounds[:-1], where))
            if d < len(s.doc_ids) and s.bounds[d] == where:
                ids = s.run(where, int(s.bounds[d + 1])).astype("<u4")
                row = (None if s.nulls[d] else int(s.doc_ids[d]), at, len(ids), ids.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return _located(spark, path, starts, start).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
