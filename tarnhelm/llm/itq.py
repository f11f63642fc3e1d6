"""Operator 4: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

On at most ``fit_rows`` vectors the principal axes are found and rotations are learned (on
ROTATION_ROWS of them) that bring them close to the corners of the cube (iterative quantisation); signs of the rotated
coordinates are balanced codes.  A code's bits are cut into substrings, one table each; two
vectors meet in a table when they share its substring and their label.  The number of
tables is calibrated so that vectors exactly at the threshold meet in one of them with
probability ``recall`` at least, measured on simulated partners of fitted vectors and on
the close pairs among them; if 2048 tables don't reach it, that is an error.
Every meeting is reranked with the original vectors, in double precision: no pair below
the threshold is ever linked.

Equal vectors of one label are one class with a count, so copies meet once.  The tables
carry whole codes, not vectors: in a bucket, pairs whose codes are further apart than any
probed pair at the threshold (and a sixteenth of the bits more) are dropped, and so are pairs
that met in an earlier table.  Only rows with a pair left fetch their vectors, and only for
that bucket.  Links are then found by blocks of bounded size; only counts and a spanning
forest leave a bucket, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
a null label, or another dimension than the commonest, link with nothing; a repeated id is
a row of its own, and its rows can link; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.llm.common import Scratch, binary_rows, components, mix64, partitions, saved, slices, spread_join, units, whole_units
from tarnhelm.llm.vectors import dimension, exact_scores, matrix, sample, usable

FIT_ROWS, ROTATION_ROWS, RECALL, BLOCK, BROADCAST = 20_000, 4_000, 0.9995, 2048, 100_000


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Rotation that brings centred rows close to cube corners: signs and rotation by turns."""
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    x = x[:ROTATION_ROWS]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Codes:
    """Substrings of balanced binary codes; ``bits`` a substring, ``tables`` of them."""

    def __init__(self, x: np.ndarray, threshold: float, bits: int, recall: float, seed: int = 0, most: int = 2048):
        rng = np.random.default_rng(seed)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.bits, self.tables, dim = bits, 0, x.shape[1]
        axes = np.linalg.svd(x - x.mean(0), full_matrices=len(x) < dim)[2]
        # partners at exactly the threshold in random directions, and the sample's own close pairs
        probe = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
        away = rng.standard_normal(probe.shape)
        away -= (away * probe).sum(1, keepdims=True) * probe
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        partner = threshold * probe + math.sqrt(max(0.0, 1 - threshold**2)) * away
        i, j = np.nonzero(np.triu(probe @ probe.T >= threshold, 1))
        pick = rng.choice(len(i), min(len(i), 20_000), replace=False)
        pairs = [(probe, partner), (probe[i[pick]], probe[j[pick]])]
        met = [np.zeros(len(a), bool) for a, _ in pairs]
        apart = [np.zeros(len(a), np.int64) for a, _ in pairs]
        maps, offsets = [], []
        while self.tables < most and any(m.mean() < recall for m in met if len(m)):
            # by turns around the mean, which balances the codes, and around the origin
            middle = x.mean(0) if len(maps) // max(1, dim // bits) % 2 == 0 else np.zeros(dim)
            r = axes.T @ learn_rotation((x - middle) @ axes.T, rng)
            for t in range(max(1, dim // bits)):
                m = r[:, t * bits : (t + 1) * bits]
                maps.append(m)
                offsets.append(middle @ m)
                for seen, far, (p, q) in zip(met, apart, pairs):
                    same = (p @ m >= offsets[-1]) == (q @ m >= offsets[-1])
                    seen |= same.all(1)
                    far += (~same).sum(1)
                self.tables += 1
        self.map, self.offset = np.concatenate(maps, axis=1), np.concatenate(offsets)
        self.recall = min(float(m.mean()) for m in met if len(m))
        self.bound = max(int(far.max(initial=0)) for far in apart) + self.tables * bits // 16
        if self.recall < recall:
            raise ValueError(f"{self.tables} tables of {bits} bits reach a recall of {self.recall:.5f}, not {recall}")

    def codes(self, x: np.ndarray) -> np.ndarray:
        """All bits of each row, as 64-bit words."""
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        raw = np.packbits(u @ self.map >= self.offset, axis=1, bitorder="little")
        out = np.zeros((len(x), -(-raw.shape[1] // 8) * 8), np.uint8)
        out[:, : raw.shape[1]] = raw
        return out.view("<u8")

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """One substring a table, as numbers."""
        on = np.unpackbits(codes.view(np.uint8), axis=1, count=self.tables * self.bits, bitorder="little")
        return (on.reshape(len(codes), self.tables, self.bits) * (1 << np.arange(self.bits))).sum(2).astype(np.int32)


def _met_before(kx: np.ndarray, ky: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether rows of keys, pair by pair, agree in a table before t."""
    return ((kx == ky) & (np.arange(kx.shape[1]) < t[:, None])).any(1)


def _close_pairs(unit: np.ndarray, own: np.ndarray, alone: np.ndarray, code: np.ndarray, bound: int):
    """Pairs of places (i, j) of sorted units whose codes are near enough, some thousands at a time.

    Small units go together, by distance in the order; in a unit of two blocks only its halves meet.
    """
    start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    length = np.diff([*start, len(unit)])
    size = np.repeat(length, length)

    def near(i, j):
        for at in range(0, len(i), 32_768):
            x, y = i[at : at + 32_768], j[at : at + 32_768]
            ok = np.bitwise_count(code[x] ^ code[y]).sum(1) <= bound
            if ok.any():
                yield x[ok], y[ok]

    place = np.flatnonzero(size <= 64)
    for d in range(1, 64):
        i, j = place[: max(0, len(place) - d)], place[d:]
        same = unit[i] == unit[j]
        if not same.any():
            break
        same &= alone[i] | (own[i] != own[j])
        yield from near(i[same], j[same])
    for a, n in zip(start.tolist(), length.tolist()):
        if n > 64:
            here = np.arange(a, a + n)
            for at in range(0, n, 16):
                x = here[at : at + 16]
                i, j = np.nonzero((x[:, None] < here[None, :]) & (alone[a] | (own[x][:, None] != own[here][None, :])))
                yield from near(x[i], here[j])


def _links(x: np.ndarray, y: np.ndarray, kx: np.ndarray, ky: np.ndarray, table: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of two blocks with cosine at the threshold or above that meet first in this table."""
    nx, ny = (np.sqrt(exact_scores(a, a)) for a in (x, y))
    i, j = np.nonzero((x / nx[:, None]) @ (y / ny[:, None]).T >= threshold - 1e-9)
    if same:
        i, j = i[i < j], j[i < j]
    if table and len(i):
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= kx[i, t] != ky[j, t]
        i, j = i[new], j[new]
    out_i, out_j = [], []
    for a in range(0, len(i), 65536):
        p, q = i[a : a + 65536], j[a : a + 65536]
        ok = exact_scores(x[p], y[q]) / (nx[p] * ny[q]) >= threshold
        out_i.append(p[ok])
        out_j.append(q[ok])
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (i, j)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is linked to by a path."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link(df: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vec: str = "embedding", label: str | None = "label", fit_rows: int = FIT_ROWS, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    with Scratch(df.sparkSession) as scratch:
        return saved(_linked(df, threshold, vec_id, vec, label, fit_rows, recall, scratch), "linked")


def _linked(df: DataFrame, threshold: float, vec_id: str, vec: str, label: str | None, fit_rows: int, recall: float, scratch: Scratch) -> DataFrame:
    spark, n = df.sparkSession, partitions(df.sparkSession)
    kind = df.schema[vec].dataType
    width = np.dtype("<f4") if isinstance(getattr(kind, "elementType", None), T.FloatType) else np.dtype("<f8")
    v = F.col(vec).cast("array<double>")
    good = usable(F.col(vec)) & (F.lit(True) if label is None else F.col(label).isNotNull())
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), F.when(good, v).alias("v"), (F.lit("") if label is None else F.col(label).cast("string")).alias("label"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.saved(rows, "vectors")
    dim = dimension(rows.filter(F.col("v").isNotNull()), "v")
    usable_rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == dim)).withColumn("class", F.sha2(F.concat_ws("|", "label", F.col("v").cast("string")), 256))
    # one member a class: the smallest id
    members = scratch.saved(usable_rows.select("row", "class", "label"), "members")
    classes = scratch.saved(members.groupBy("class").agg(F.min("row").alias("rep"), F.count("*").alias("size")), "sizes")
    reps = scratch.saved(rows.select("row", "v", "label").join(classes.select(F.col("rep").alias("row"), "size", "class"), "row"), "classes")
    fitted = sample(reps, "v", fit_rows, "row")
    if not len(fitted):
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    crowd = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    bits = int(min(max(6, math.ceil(math.log2(max(crowd, 2) / 16))), 24, max(1, dim)))
    codes = Codes(fitted, threshold, bits, recall)
    shared = spark.sparkContext.broadcast(codes)
    tables, words = codes.tables, codes.codes(fitted[:1]).shape[1]
    flat = lambda a, n: binary_rows(a.ravel(), np.arange(n + 1) * a.shape[1])
    coded = lambda col: np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(-1, words)

    def file(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), flat(x.astype(width), len(x)), b.column(2), b.column(3), flat(shared.value.codes(x), len(x))], names=["row", "v", "label", "size", "code"])

    def spread(batches):
        for b in batches:
            for part in slices(b):
                n = part.num_rows
                keys = shared.value.keys(coded(part.column(2))).astype(np.uint64)
                t = np.arange(tables, dtype=np.uint64)
                lab = part.column(1).to_numpy().view(np.uint64)
                bucket = mix64(mix64(lab[:, None] + t * np.uint64(0x9E3779B97F4A7C15)) ^ keys)
                every = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([part.column(0).take(every), pa.array(np.tile(t.astype(np.int16), n)), pa.array(bucket.ravel().view(np.int64)), part.column(2).take(every)], names=["row", "t", "bucket", "code"])

    filed = scratch.saved(reps.select("row", "v", "label", "size").mapInArrow(file, "row bigint, v binary, label string, size bigint, code binary"), "codes", "none")
    spots = filed.select("row", F.xxhash64("label").alias("lab"), "code").mapInArrow(spread, "row bigint, t smallint, bucket bigint, code binary")
    # buckets of more than one block; the table is broadcast while it is short
    big = scratch.saved(spots.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    many = big.count()
    placed = spots.join(F.broadcast(big) if many <= BROADCAST else big, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if many else spots.withColumn("blocks", F.lit(1))
    # a row goes to every pair of blocks that holds its own: (b, c) with b <= c
    placed = placed.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("row", "t", "code", F.xxhash64("bucket", F.least("own", "o"), F.greatest("own", "o")).alias("unit"), "own", (F.col("own") == F.col("o")).alias("alone"))

    def flag(batches):
        """Rows with a pair left in their unit."""
        for b in whole_units(batches):
            unit, own, t = (b.column(c).to_numpy() for c in ("unit", "own", "t"))
            code = coded(b.column("code"))
            keys, mark = shared.value.keys(code), np.zeros(len(unit), bool)
            for i, j in _close_pairs(unit, own, b.column("alone").to_numpy(zero_copy_only=False), code, shared.value.bound):
                first = ~_met_before(keys[i], keys[j], t[i])
                mark[i[first]] = mark[j[first]] = True
            if mark.any():
                yield b.select(["row", "t", "unit", "own", "alone"]).filter(pa.array(mark))

    flagged = placed.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(flag, "row bigint, t smallint, unit bigint, own int, alone boolean")
    flagged = scratch.saved(flagged, "flagged")
    met = flagged.join(filed, "row").repartition(n, "unit").sortWithinPartitions("unit", "own", "row")

    def meet(batches):
        for u in units(batches):
            t, alone = u.column("t")[0].as_py(), u.column("alone")[0].as_py()
            row, own_b, size = (u.column(c).to_numpy() for c in ("row", "own", "size"))
            x = np.frombuffer(b"".join(u.column("v").to_pylist()), width).astype(np.float64).reshape(len(row), -1)
            keys = shared.value.keys(coded(u.column("code")))
            if alone:
                i, j = _links(x, x, keys, keys, t, threshold, True)
            else:
                cut = int(np.searchsorted(own_b, own_b[-1]))
                i, j = _links(x[:cut], x[cut:], keys[:cut], keys[cut:], t, threshold, False)
                j = j + cut
            labels = u.column("label").dictionary_encode()
            if len(labels.dictionary) > 1:  # two labels with one bucket key
                code = labels.indices.to_numpy()
                i, j = i[code[i] == code[j]], j[code[i] == code[j]]
            if len(i):
                count = np.zeros(len(row), np.int64)
                np.add.at(count, i, size[j])
                np.add.at(count, j, size[i])
                root = _forest(len(row), i, j)
                on = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(row[on]), pa.array(count[on]), pa.array(row[root[on]])], names=["row", "links", "root"])

    found = scratch.saved(met.mapInArrow(meet, "row bigint, links bigint, root bigint"), "meetings")
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), into=scratch)
    # classes: links to the other copies and to linked classes; component by the smallest id in it
    info = reps.select("row", "class", "size").join(counts, "row", "left").join(comps.withColumnRenamed("node", "row"), "row", "left")
    info = info.select("class", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "row").alias("component"))
    info = scratch.saved(info.filter("links > 0"), "linked")  # only rows with links go on
    every = members.count()
    of_row = spread_join(members.select("row", "class"), info, "class", "size", every).select("row", "links", "component")
    of_row = scratch.saved(of_row.join(rows.select("row", "id"), "row"), "linked-rows")
    least = scratch.saved(of_row.groupBy("component").agg(F.min("id").alias("first"), F.count("*").alias("c")), "least")
    named = spread_join(of_row, least, "component", "c", every).select("row", "links", "first")
    out = rows.select("row", "id").join(named, "row", "left")
    cid = F.coalesce("first", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), cid.alias("component_id"), cid.eqNullSafe(F.col("id")).alias("kept"))
