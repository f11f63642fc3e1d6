"""Operator 5: bulk-synchronous best-fit packing of token sequences.

Pieces and the gaps of open sequences are integers from 0 to the capacity, so each side of
a sweep is a sorted list of runs: a size with the number of its members.  A round takes
the next longest pieces and sweeps the gaps for the successor of their size (the smallest
gap that still holds them).  Where several pieces want one gap, rank decides: piece number
r of the run takes member r of the gap run, and what is left over goes to the next gap.
Then gaps shrink and the next round starts; pieces without a gap open sequences.  That is
best-fit decreasing, exactly, and the runs that the driver holds are bounded by the
capacity, never by the rows.

The rows meet the decisions by rank alone: pieces are range-sorted by (length, row), the
partitions' counts of each length turn positions into ranks, and each rank falls into one
decided run (a table that is broadcast and bounded by the capacity).  No group of rows is ever
gathered in one task, however frequent its length is.

Defined results: null or empty texts make one piece, the end id alone; repeated rows are
packed each; an empty table gives an empty table; only doc_id and text are used.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.llm.bpe import REMEMBER, encoder_of
from tarnhelm.llm.common import binary_rows, partitions, saved, slices, texts_of


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length, ids: every text's ids and the end id, cut only if longer than the capacity."""

    def run(batches):
        encoder = encoder_of(tokenizer, remember)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, bounds = encoder.encode(texts_of(part.column(1)))
                flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(len(bounds))
                lens = np.diff(bounds)
                n = -(-lens // capacity)
                row = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(lens[row] - start, capacity)
                cuts = np.concatenate([[0], np.cumsum(length)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), binary_rows(flat.astype("<u4"), cuts)],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over runs.

    Returns decided runs (length, first rank, number, first sequence, pieces a sequence,
    offset): piece ``rank`` of that length goes to sequence ``first + (rank - first rank) //
    each`` at ``offset + (rank - first rank) % each * length``.
    """
    gaps: list[int] = []  # sorted sizes that have members
    members: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, number)
    out, opened = [], 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in members:
                insort(gaps, gap)
                members[gap] = []
            members[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(first: int, n: int, each: int, gap: int, length=length) -> None:
            nonlocal left, rank
            out.append((length, rank, n * each, first, each, capacity - gap))
            rank, left = rank + n * each, left - n * each
            give(gap - each * length, first, n)

        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full = left // each
                if full:
                    put(opened, full, each, capacity)
                    opened += full
                if left:
                    put(opened, 1, left, capacity)
                    opened += 1
                break
            gap = gaps[at]
            first, n = members[gap].pop()
            if not members[gap]:
                del members[gap]
                gaps.pop(at)
            each = gap // length
            use = min(n, left // each)
            if use < n:  # members that stay as they are, but for one that may take the remainder
                rest = left - use * each
                give(gap, first + use + bool(rest), n - use - bool(rest))
                if use:
                    put(first, use, each, gap)
                if rest:
                    put(first + use, 1, rest, gap)
            else:
                put(first, n, each, gap)
    return out


def place(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """(row, length) -> (row, sequence_id, offset); ``row`` must be unique."""
    spark = sizes.sparkSession
    n = partitions(spark)
    ranked = saved(sizes.select("row", "length").repartitionByRange(n, "length", "row").withColumn("part", F.spark_partition_id()), "ranked")
    # a length and partition pair a row: as many as lengths plus partitions, since parts are ranges
    counts = ranked.groupBy("length", "part").count().orderBy("length", "part").collect()
    total: dict[int, int] = {}
    before = []
    for r in counts:
        before.append((r["length"], r["part"], total.get(r["length"], 0)))
        total[r["length"]] = total.get(r["length"], 0) + r["count"]
    decided = np.array(sorted(sweep(total, capacity)), np.int64).reshape(-1, 6)  # bounded by the capacity
    runs = spark.sparkContext.broadcast(decided)
    offsets = spark.createDataFrame(before, "length bigint, part int, before bigint")
    w = Window.partitionBy("part", "length").orderBy("row")
    rank = ranked.join(F.broadcast(offsets), ["length", "part"]).select("row", "length", (F.col("before") + F.row_number().over(w) - 1).alias("rank"))

    def run(batches):
        table = runs.value
        keys = table[:, 0] << 40 | table[:, 1]
        for b in batches:
            row, length, at = (c.to_numpy() for c in b.columns)
            hit = table[np.searchsorted(keys, length << 40 | at, side="right") - 1]
            step, each = at - hit[:, 1], hit[:, 4]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(hit[:, 3] + step // each), pa.array(hit[:, 5] + step % each * length)], names=["row", "sequence_id", "offset"])

    return rank.mapInArrow(run, "row bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for every piece.

    ``remember``: words that a worker keeps the ids of; memory against speed, never results."""
    pieces = saved(pieces_of(docs, tokenizer, capacity, end_id, doc_id, text, remember).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(place(pieces, capacity), "row").drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (little-endian u32), at most the capacity each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
