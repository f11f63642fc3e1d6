"""Operator 3: nearest neighbours through a hierarchical k-means tree, best bin first.

The tree is fitted on at most ``fit_rows`` vectors; every vector is filed under the leaf it
falls into.  Leaves that are crowded by all rows are split further, each by a task on a sample
of its own rows, so that leaves grow with the table until the tree takes ``tree_bytes``.  Inner products become distances by one more coordinate (what a vector's square
lacks of the largest square), so the nearest are those of largest inner product.  A query
goes through the tree with a priority queue of nodes by distance and visits the leaves in
the order in which they come out.

How many leaves a query visits is calibrated: for at most ``calibrate`` queries the true
neighbours are found against all rows in blocks, and the visit is widened until the mean
share of true neighbours in visited leaves reaches ``recall``.

Leaves with many rows are cut into blocks, and leaves with many visitors into chunks, so
that a task's unit of work is bounded however the rows cluster.  The tables of block and
chunk numbers have one entry a leaf, and leaves are bounded by ``tree_bytes``.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those of another dimension than the commonest; equal scores go to the
smaller id; a row is never a neighbour of its own id; fewer
candidates than ``k`` give them all; rows that repeat an id are one candidate where their
scores agree, and one query; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnhelm.llm.common import Scratch, partitions, saved, units
from tarnhelm.llm.vectors import dimension, exact_scores, matrix, sample, usable

FIT_ROWS, CALIBRATE, RECALL = 20_000, 256, 0.95
BLOCK, CHUNK = 4096, 1024
#: Bytes of a tree's centers, which the driver holds and broadcasts.
TREE_BYTES = 64 << 20
#: Parts that a leaf is split into in one pass, passes, and sampled rows for each part.
PARTS, PASSES, PART_ROWS = 1024, 3, 8


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", centers, centers) - 2 * x @ centers.T).argmin(1)


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centers)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers[np.unique(_nearest(x, centers))]


class Tree:
    """Nodes in arrays: children of node i are first[i] to first[i] + count[i]; leaves have none."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branching: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.centers, self.first, self.count = [np.zeros(x.shape[1])], [0], [0]
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            centers = _lloyd(rows, min(branching, max(2, len(rows) // leaf_rows + 1)), rng)
            if len(centers) < 2:  # equal rows can't be split
                continue
            self.first[node], self.count[node] = len(self.first), len(centers)
            at = _nearest(rows, centers)
            for i, c in enumerate(centers):
                self.centers.append(c)
                self.first.append(0)
                self.count.append(0)
                todo.append((self.first[node] + i, rows[at == i]))
        self.centers, self.grafts = np.array(self.centers), []
        self.leaves = [i for i, n in enumerate(self.count) if not n]

    def graft(self, leaf: int, first: np.ndarray, count: np.ndarray, centers: np.ndarray) -> None:
        """Put the nodes of another tree below a leaf, which takes the place of its root; then call ``settle``."""
        shift = len(self.first) - 1
        first = np.where(count > 0, first + shift, 0)
        self.first[leaf], self.count[leaf] = int(first[0]), int(count[0])
        self.first += first[1:].tolist()
        self.count += count[1:].tolist()
        self.grafts.append(centers[1:])

    def settle(self) -> None:
        self.centers = np.concatenate([self.centers, *self.grafts])
        self.grafts = []
        self.leaves = [i for i, n in enumerate(self.count) if not n]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live := live[np.array([self.count[i] > 0 for i in node[live]], bool)]):
            for p in np.unique(node[live]):
                rows = live[node[live] == p]
                a = self.first[p]
                node[rows] = a + _nearest(x[rows], self.centers[a : a + self.count[p]])
        return node

    def visit(self, q: np.ndarray, most: int, ids_in: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``most`` of them, or more until they hold ``least`` ids."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < least):
            _, i = heapq.heappop(queue)
            if not self.count[i]:
                out.append(i)
                held += ids_in.get(i, 0) if ids_in else 0
                continue
            a = self.first[i]
            d = ((self.centers[a : a + self.count[i]] - q) ** 2).sum(1)
            for j, x in enumerate(d.tolist()):
                heapq.heappush(queue, (x, a + j))
        return out


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    """One more coordinate that makes all squares equal: nearest then means largest inner product."""
    rest = np.sqrt(np.maximum(square - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _flat(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """Which places of a sorted array are among the first k of their value."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return np.arange(len(group)) - np.repeat(start, np.diff([*start, len(group)])) < k


def best_of(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block, the k best rows for each query: (query's place, row's place, score), its own id excluded, ties to the smaller id."""
    rough = q @ c.T
    rough[q_ids[:, None] == c_ids[None, :]] = -np.inf
    near = rough > -np.inf
    if len(c) > k:
        edge = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k]
        near &= rough >= np.where(np.isfinite(edge), edge - 1e-9 * (1 + np.abs(edge)), -np.inf)[:, None]
    i, j = np.nonzero(near)
    s = exact_scores(q[i], c[j])
    order = np.lexsort((c_ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = _first(i, k)
    return i[keep], j[keep], s[keep]


class _Best:
    """The k best found so far for each query, of distinct (id, score) pairs."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part[0])

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1])])[: len(q)]
        q, i, s = q[new], i[new], s[new]
        keep = _first(q, self.k)
        self.parts = [(q[keep], i[keep], s[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


def _merged(batches, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, vec_id, score) sorted by query: the k best of each, ranked."""
    best = _Best(k)
    for last, b in _with_last(batches):
        if b.num_rows:
            best.add(*(c.to_numpy() for c in b.columns))
        q, i, s = best.settle()
        done = np.ones(len(q), bool) if last else q < q[-1] if len(q) else np.zeros(0, bool)
        if done.any():
            start = np.searchsorted(q[done], q[done])
            yield pa.RecordBatch.from_arrays([pa.array(q[done]), pa.array((np.arange(len(start)) - start + 1).astype(np.int32)), pa.array(i[done]), pa.array(s[done])], names=["query_id", "rank", "vec_id", "score"])
        best.parts = [(q[~done], i[~done], s[~done])]


def _with_last(batches):
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held


def search(df: DataFrame, queries: DataFrame | None = None, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", leaf_size: int = 512, fit_rows: int = FIT_ROWS, calibrate: int = CALIBRATE, recall: float = RECALL, branching: int = 16, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``df`` found for each row of ``queries`` (default: all).

    Leaves hold about ``leaf_size`` rows as long as ``tree_bytes`` allow; equal rows stay in one leaf."""
    with Scratch(df.sparkSession) as scratch:
        return saved(_searched(df, queries, k, vec_id, vec, leaf_size, fit_rows, calibrate, recall, branching, tree_bytes, scratch), "nearest")


def _searched(df: DataFrame, queries: DataFrame | None, k: int, vec_id: str, vec: str, leaf_size: int, fit_rows: int, calibrate: int, recall: float, branching: int, tree_bytes: int, scratch: Scratch) -> DataFrame:
    spark = df.sparkSession
    tidy = lambda x: x.filter(usable(F.col(vec)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    base, asked = tidy(df), tidy(df if queries is None else queries)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = dimension(base, "v")
    if not dim:
        return empty
    base, asked = base.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    fitted = sample(base, "v", fit_rows, "id")
    square = base.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()["m"]
    share = len(fitted) / max(base.count(), 1)
    tree = Tree(_lift(fitted, square), max(8, round(leaf_size * share)), branching)
    filed, rows_in = _filed(base, tree, square, scratch)
    whole: set[int] = set()  # leaves that can't be split
    for _ in range(PASSES):
        if not _grown(tree, filed, rows_in, whole, square, leaf_size, branching, tree_bytes):
            break
        filed, rows_in = _filed(base, tree, square, scratch)
    shared = spark.sparkContext.broadcast(tree)
    visits = _calibrated(filed, asked, tree, k, calibrate, recall)

    # work units: a block of a leaf's rows by a chunk of its visitors
    # an id counts in one leaf only, so that leaves hold no fewer distinct ids than the sum; one may be the query's own
    ids_in = {r["leaf"]: r["count"] for r in filed.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect()}

    def go(batches):
        for b in batches:
            for i, q in zip(range(b.num_rows), _flat(matrix(b.column(1)))):
                leaves = [x for x in shared.value.visit(q, visits, ids_in, k + 1) if x in rows_in]
                one = pa.array(np.full(len(leaves), i))
                if leaves:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(one), b.column(1).take(one), pa.array(leaves, pa.int64())], names=["id", "v", "leaf"])

    routed = asked.mapInArrow(go, "id bigint, v array<double>, leaf bigint")
    routed = scratch.saved(routed, "routed")
    asked_of = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}
    unit = {leaf: (-(-n // BLOCK), -(-asked_of[leaf] // CHUNK)) for leaf, n in rows_in.items() if leaf in asked_of}
    if not unit:
        return empty
    table = F.broadcast(spark.createDataFrame([(leaf, b, c) for leaf, (b, c) in unit.items()], "leaf bigint, blocks bigint, chunks bigint"))
    spread = lambda x, n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = filed.join(table, "leaf").select("leaf", spread("id", "blocks").alias("block"), every("chunks").alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    right = routed.join(table, "leaf").select("leaf", every("blocks").alias("block"), spread("id", "chunks").alias("chunk"), F.lit(True).alias("asks"), "id", "v")
    n = partitions(spark)
    met = left.union(right).repartition(n, "leaf", "block", "chunk").sortWithinPartitions("leaf", "block", "chunk", "asks", "id")

    def meet(batches):
        best = _Best(k)

        def out():
            q, i, s = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])
            best.parts, best.size = [], 0

        for unit_rows in _units(batches):
            asks = unit_rows.column(3).to_numpy(zero_copy_only=False)
            ids, vs = unit_rows.column(4).to_numpy(), matrix(unit_rows.column(5))
            q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
            if len(q) and len(c):
                i, j, s = best_of(vs[q], ids[q], vs[c], ids[c], k)
                best.add(ids[q][i], ids[c][j], s)
            if best.size > 400_000:
                best.settle()
                if best.size > 200_000:
                    yield from out()
        yield from out()

    found = met.mapInArrow(meet, "query_id bigint, vec_id bigint, score double")
    return found.repartition(n, "query_id").sortWithinPartitions("query_id").mapInArrow(lambda batches: _merged(batches, k), "query_id bigint, rank int, vec_id bigint, score double")


def _filed(base: DataFrame, tree: Tree, square: float, scratch: Scratch) -> tuple[DataFrame, dict[int, int]]:
    """id, v, leaf of every row, and each leaf's number of rows."""
    shared = base.sparkSession.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.assign(_lift(matrix(b.column(1)), square)), pa.int64())], names=["id", "v", "leaf"])

    filed = scratch.saved(base.mapInArrow(file, "id bigint, v array<double>, leaf bigint"), "filed")
    return filed, {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}


def _grown(tree: Tree, filed: DataFrame, rows_in: dict[int, int], whole: set[int], square: float, leaf_size: int, branching: int, tree_bytes: int) -> bool:
    """Split leaves with more than twice ``leaf_size`` rows, each on a sample of its rows; whether any was split.

    A sample has PARTS * PART_ROWS rows or so however large its leaf is, and the new nodes fit into what is left of ``tree_bytes``.
    """
    spark = filed.sparkSession
    wanted = {leaf: min(PARTS, -(-n // leaf_size)) for leaf, n in rows_in.items() if n > 2 * leaf_size and leaf not in whole}
    # inner nodes: a tenth more than leaves or so; a leaf is split in two at least, or not
    room = max(0, tree_bytes // (8 * tree.centers.shape[1]) - len(tree.centers)) // 2
    if not wanted or room < 2:
        return False
    scale = min(1.0, room / sum(wanted.values()))
    parts, used = {}, 0
    for leaf in sorted(wanted, key=lambda x: (-rows_in[x], x)):
        m = max(2, int(wanted[leaf] * scale))
        if used + m > room:
            break
        parts[leaf], used = m, used + m
    table = F.broadcast(spark.createDataFrame([(leaf, m, min(1.0, m * PART_ROWS / rows_in[leaf])) for leaf, m in parts.items()], "leaf bigint, parts bigint, rate double"))
    drawn = filed.join(table, "leaf").filter(F.rand(11) < F.col("rate")).select("leaf", "parts", "id", "v")

    def fit(batches):
        for unit in units(batches, "leaf"):
            x = _lift(matrix(unit.column(3)), square)
            sub = Tree(x, max(2, len(x) // unit.column(1)[0].as_py()), branching)
            n = len(sub.first)
            flat = pa.array(sub.centers.ravel())
            centers = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array([unit.column(0)[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(sub.first, pa.int64()), pa.array(sub.count, pa.int64()), centers], names=["leaf", "node", "first", "count", "center"])

    fits = drawn.repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", "id", "v").mapInArrow(fit, "leaf bigint, node bigint, first bigint, count bigint, center array<double>")
    nodes = fits.orderBy("leaf", "node").toArrow().combine_chunks()  # bounded by ``room``
    leaf, first, count = (nodes.column(c).to_numpy() for c in ("leaf", "first", "count"))
    centers = matrix(nodes.column("center").combine_chunks()) if len(leaf) else np.zeros((0, tree.centers.shape[1]))
    starts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]])) if len(leaf) else np.zeros(0, np.int64)
    split = set()
    for a, z in zip(starts, [*starts[1:], len(leaf)]):
        if z - a > 1:
            tree.graft(int(leaf[a]), first[a:z], count[a:z], centers[a:z])
            split.add(int(leaf[a]))
    whole.update(parts.keys() - split)
    tree.settle()
    return bool(split)


def _units(batches) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut where leaf, block or chunk changes; a unit is bounded by BLOCK and CHUNK (about)."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if rest is not None and rest.num_rows:
            b = pa.concat_batches([rest, b])
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in range(3)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        for a, z in zip([0, *cuts[:-1]], cuts):
            yield b.slice(a, z - a)
        rest = b.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _calibrated(filed: DataFrame, asked: DataFrame, tree: Tree, k: int, calibrate: int, recall: float) -> int:
    """The least number of leaves that holds the wanted share of true neighbours, over a bounded set of queries."""
    spark = filed.sparkSession
    probe = asked.orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(calibrate).toArrow()
    if not probe.num_rows:
        return 1
    q_ids, q = probe.column(0).to_numpy(), matrix(probe.column(1).combine_chunks())
    shared = spark.sparkContext.broadcast((q_ids, q))

    def blocks(batches):
        (ids, qs), best = shared.value, _Best(k)
        for b in batches:
            if b.num_rows:
                c_ids = b.column(0).to_numpy()
                i, j, s = best_of(qs, ids, matrix(b.column(1)), c_ids, k)
                best.add(ids[i], c_ids[j], s)
                best.settle()
        q, i, s = best.settle()  # k a query and task
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    near = filed.mapInArrow(blocks, "query_id bigint, vec_id bigint, score double").repartition(partitions(spark), "query_id").sortWithinPartitions("query_id")
    top = near.mapInArrow(lambda batches: _merged(batches, k), "query_id bigint, rank int, vec_id bigint, score double")
    # calibrate * k rows at most
    placed = filed.select(F.col("id").alias("vec_id"), "leaf").join(F.broadcast(top), "vec_id").groupBy("query_id", "rank").agg(F.min("leaf").alias("leaf"))
    true: dict[int, list[int]] = {}
    for r in placed.collect():
        true.setdefault(r["query_id"], []).append(r["leaf"])
    shares = np.zeros(len(tree.leaves) + 1)
    used = 0
    for i, x in zip(q_ids.tolist(), _flat(q)):
        if true.get(i):
            place = {leaf: p for p, leaf in enumerate(tree.visit(x, len(tree.leaves)))}
            np.add.at(shares, [place[leaf] for leaf in true[i]], 1 / len(true[i]))
            used += 1
    reached = np.cumsum(shares) / max(used, 1)
    return int(np.argmax(reached >= min(recall, reached[-1]) - 1e-12)) + 1
