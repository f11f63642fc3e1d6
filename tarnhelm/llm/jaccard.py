"""Operator 9: Jaccard similarity join on word shingles with token-combination prefixes.

Shingles are ordered by frequency, rarest first (by a table of counts over all documents in
steps of a 64th of a doubling, then by digest: any order that all documents share gives the
same links, so the table's fixed size bears on speed alone).  With ``p`` the prefix in which
a document shares a shingle with every partner, it shares G + 1 of them in a prefix of
p + G.  That extended prefix is indexed by single shingles first, and how many documents an
entry really has decides its class.  A rare shingle's entry stays.  Frequent shingles
(FREQUENT documents or more) go back to their documents, are dealt into G groups by digest,
and are indexed in pairs inside a group: of G + 1 shared ones two fall into one group.  So
a common line brings documents together only with a second one.  G grows with the document
(half of p), which keeps pairs in proportion to the prefix at every length; documents near a
step of G index for both sides of it, for the smaller G from the shorter prefix that it needs.

Documents that meet are verified on their whole sets, in two rounds.  The first tries
neighbours in the order of size within each index entry, and each entry's least document;
what it links is already one component.  The second tries every pair of an entry whose two
sides still are in different components, so components are exact, yet a group of copies
costs about one test a member.  An upper bound from counts of shingles in 64 classes drops
most pairs before their texts are fetched; it never drops a link.  The second round applies
it where documents of an entry meet, in blocks of bounded size, and lets only the pairs out
that it allows.  A pair leaves from the largest entry that it shares: each document brings
a short list of its largest entries, and a pair whose lists share an entry before the one
at hand is left to that one.  Pairs that share none of the listed ones may leave more than
once, never less.

Texts with the same words are one class from the start, and one document indexes it (one a
task where copies are more than BROADCAST_IDS).  Entries of shingles with very many
documents are dealt by salts before they move, joins on hot keys are split, and comparisons
run in blocks, so no group is gathered in one task.

Sets are of 64-bit digests; two different shingles are taken for one with a probability of
about 2**-64 (see shingles.py).

Defined results: null texts and texts without words have the empty set and link with
nothing; rows that repeat an id are one document, which links if any of its rows does; a
row without an id keeps a null component; an empty table gives an empty table; texts of any
length are read whole, in chunks; columns other than the id and the text are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnhelm.llm.common import Scratch, components, kept, mix64, partitions, saved, slices, spread_join, whole_units
from tarnhelm.llm.shingles import bytes_of, sets_of

#: Entries of the table of counts, which orders shingles; its size doesn't grow with the data.
SKETCH_BITS, SKETCH_CUT = 20, 16
#: Documents that make a shingle frequent, and rows of one entry that may go to one task.
FREQUENT, SALT_ROWS = 128, 512
CLASSES, BLOCK, BROADCAST_IDS = 64, 2048, 1_000_000
#: Entries that a document lists, and how many documents make an entry worth listing.
LISTED, LISTED_FROM = 16, 16
_CELL = np.uint64((1 << SKETCH_BITS) - 1)


def _features(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, key and profile (shingles in each of 64 classes) of each document; and, with
    ``cut`` set, a task's counts of shingle digests."""

    def run(batches):
        kept("shingles")  # another operator's memory would lie idle
        task, counts = TaskContext.get().partitionId(), np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "n", "key", "profile", "task", "cut", "counts"]
        for batch in batches:
            for part in slices(batch, "text"):
                sets, keys = sets_of(bytes_of(part.column(1)), k, keyed=True)
                n, prof = list(map(len, sets)), list(map(_profile, sets))
                np.add(counts, np.bincount(np.concatenate(sets) & _CELL, minlength=1 << SKETCH_BITS).astype(np.uint32), out=counts)
                none = pa.nulls(part.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(prof, pa.binary()), none, none, pa.nulls(part.num_rows, pa.binary())], names=names)
        if counts.any():
            cuts = np.split(counts, 1 << (SKETCH_BITS - SKETCH_CUT))
            m = len(cuts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array([task] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, key binary, profile binary, task int, cut int, counts binary")


def _summed(counts: DataFrame) -> np.ndarray:
    """The tasks' counts added up, in two levels of streams; fixed in size whatever the data."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for cut, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64) if len(raw.as_buffer()) == 4 << SKETCH_CUT else np.frombuffer(raw.as_buffer(), np.uint64)
                total[cut] = total[cut] + x if cut in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["cut", "counts"])

    n = 1 << (SKETCH_BITS - SKETCH_CUT)
    some = counts.repartition(partitions(counts.sparkSession), "cut", F.floor(F.col("task") / 64)).select("cut", "counts").mapInArrow(add, "cut int, counts binary")
    rows = some.repartition(n, "cut").mapInArrow(add, "cut int, counts binary").collect()
    out = np.zeros((n, 1 << SKETCH_CUT), np.uint64)
    for r in rows:
        out[r["cut"]] += np.frombuffer(r["counts"], np.uint64)
    return out.ravel()


class Order:
    """The order of shingles, and the salts of those with very many documents: two small tables."""

    def __init__(self, counts: np.ndarray, salt_rows: int):
        self.level = np.floor(np.log2(counts.astype(np.float64) + 1) * 64).astype(np.uint16)
        over = np.maximum(counts.astype(np.float64) - 2 * counts.mean(), 0)
        self.salts = np.minimum(1 + over // salt_rows, 65_535).astype(np.uint16)

    def prefix(self, h: np.ndarray, m: int, core: int) -> tuple[np.ndarray, np.ndarray]:
        """The first m of a set of digests, and which of them are among the first ``core``."""
        key = (self.level[h & _CELL].astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))
        if m < len(h):  # equal keys stay together, so every document cuts alike
            keep = key <= np.partition(key, m - 1)[m - 1]
            h, key = h[keep], key[keep]
        return h, key <= np.partition(key, core - 1)[core - 1] if core < len(h) else np.ones(len(h), bool)

    def salts_of(self, tokens: np.ndarray) -> np.ndarray:
        return self.salts[tokens & _CELL].astype(np.uint64)


def _prefix_size(n: int, percent: int) -> int:
    """Shingles among which a set of n shares one with each partner."""
    return n - -(-percent * n // 100) + 1


def groups_of(n: int, percent: int) -> int:
    """G for sets from the power of two at or below n on: half of their prefix, less than what partners share."""
    least = 1 << (n.bit_length() - 1)
    return max(1, min(_prefix_size(least, percent) // 2, -(-percent * least // 100) - 1))


def indexed_sizes(n: int, percent: int) -> tuple[int, int]:
    """The lengths of the extended prefix, and of the one for the smallest G."""
    p, small = _prefix_size(n, percent), groups_of(-(-percent * n // 100), percent)
    return min(n, p + groups_of(n, percent)), min(n, p + small)


def combined(tokens: np.ndarray, core: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first, second): what a document of n shingles indexes for its frequent ones.

    It pairs inside the groups of its own G and of those of smaller partners: two documents
    meet by the G of the smaller one.  ``core`` marks the shingles that the smallest G needs.
    Sets so small that one shared shingle may be enough index each shingle too (first = second).
    """
    one, two = [], []
    mixed = mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sizes = sorted({groups_of(1 << j, percent) for j in range((-(-percent * n // 100)).bit_length() - 1, n.bit_length())})
    for g in sizes:
        use = core if g == sizes[0] else slice(None)
        group = mixed[use] % np.uint64(g)
        order = np.lexsort((tokens[use], group))
        t, group = tokens[use][order], group[order]
        for d in range(1, len(t)):
            same = group[d:] == group[:-d]
            if not same.any():
                break
            one.append(t[:-d][same])
            two.append(t[d:][same])
    if n * percent <= 100:
        one.append(tokens)
        two.append(tokens)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two))
    entry, first = np.unique(mix64(a * np.uint64(0x9FB21C651E98DF25) ^ mix64(b + np.uint64(1))), return_index=True)
    return entry, a[first], b[first]


def _salt(node: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """0 for entries that stay whole, else from 1 to their number of salts."""
    return np.where(salts > 1, 1 + mix64(node.astype(np.int64).view(np.uint64)) % salts, 0).astype(np.int32)


_ENTRY = "token bigint, salt int, node bigint, size bigint, core boolean"
_NAMES = ["token", "salt", "node", "size", "core"]


def _index(docs: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """token, salt, node, size: every shingle of the extended prefix; a task indexes texts with the same words once."""

    def run(batches):
        kept("index")
        order, seen = shared.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                ids, token, core, node, size, count = part.column(0).to_pylist(), [], [], [], [], []
                sets, keys = sets_of(bytes_of(part.column(1)), k, keyed=True)
                for i, h, key in zip(ids, sets, keys):
                    if i is None or key is None or key in seen:
                        continue
                    if len(seen) < 1_000_000:  # beyond that copies are indexed again, which changes nothing
                        seen.add(key)
                    t, c = order.prefix(h, *indexed_sizes(len(h), percent))
                    token.append(t), core.append(c), node.append(i), size.append(len(h)), count.append(len(t))
                if token:
                    t, who = np.concatenate(token), np.repeat(np.array(node, np.int64), count)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(_salt(who, order.salts_of(t))), pa.array(who), pa.array(np.repeat(np.array(size, np.int64), count)), pa.array(np.concatenate(core))], names=_NAMES)

    return docs.mapInArrow(run, _ENTRY)


def _combinations(frequent: DataFrame, percent: int, shared) -> DataFrame:
    """Pairs of each document's frequent shingles; a list is a part of the document's own prefix."""

    def run(batches):
        order = shared.value
        for batch in batches:
            for node, size, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                tokens, core = some.values.field("token").to_numpy(), some.values.field("core").to_numpy(zero_copy_only=False)
                t, a, b = combined(tokens.view(np.uint64), core, size, percent)
                if len(t):
                    who = np.full(len(t), node, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(_salt(who, np.minimum(order.salts_of(a), order.salts_of(b)))), pa.array(who), pa.array(np.full(len(t), size, np.int64)), pa.array(np.ones(len(t), bool))], names=_NAMES)

    return frequent.groupBy("node", "size").agg(F.collect_list(F.struct("token", "core")).alias("tokens")).mapInArrow(run, _ENTRY)


def _entered(rows: DataFrame, percent: int) -> DataFrame:
    """Entries with company: how many rows they have (``c``), each row's neighbour by size and the
    least document of the entry, where the sizes allow a link."""
    by = Window.partitionBy("token", "salt")
    w = by.orderBy("size", "node")
    rows = rows.repartition(partitions(rows.sparkSession), "token", "salt")
    rows = rows.withColumn("prev", F.lag(F.struct("node", "size")).over(w)).withColumn("c", F.count("*").over(by)).withColumn("head", F.min(F.struct("node", "size")).over(by))
    near = lambda x: F.when(_close(F.col(f"{x}.size"), F.col("size"), percent), F.col(f"{x}.node")).alias(x)
    return rows.filter("c > 1 OR salt > 0").select(*_NAMES, "c", near("prev"), near("head"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the given documents.

    The list of nodes is broadcast while it is short (BROADCAST_IDS at most, counted first), so
    that other texts stay where they are; a longer list is joined by a shuffle.
    """
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    return docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")


def _close(small: Column, large: Column, percent: int) -> Column:
    return 100 * F.least(small, large) >= percent * F.greatest(small, large)


def _profile(h: np.ndarray) -> bytes:
    """A set's size and its counts in each class, in one byte each: rounded up to a multiple of the scale."""
    c = np.bincount(h >> np.uint64(58), minlength=CLASSES)
    scale = max(1, -(-int(c.max()) // 255))
    return np.array([scale, len(h)], "<u4").tobytes() + (-(-c // scale)).astype("u1").tobytes()


def _profiles(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (a row a set) and sizes."""
    x = np.frombuffer(b"".join(raw), "u1").reshape(-1, CLASSES + 8)
    head = np.ascontiguousarray(x[:, :8]).view("<u4")
    counts = x[:, 8:].astype(np.int32) * head[:, :1].astype(np.int32)
    return counts.astype(np.int16) if counts.max(initial=0) < 1 << 15 else counts, head[:, 1].astype(np.int64)


def _possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether profiles of sets of n and m allow the similarity: an intersection has no more of a class than either set."""
    most = np.minimum(x, y).sum(-1, dtype=np.int64)
    return 100 * most >= percent * (n + m - most)


def _beside(pairs: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    p = pairs.join(rows.select(F.col("node").alias("a"), F.col(col).alias("x")), "a")
    return p.join(rows.select(F.col("node").alias("b"), F.col(col).alias("y")), "b").select("a", "b", "x", "y")


def _bounded(pairs: DataFrame, profiles: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose profiles allow a link."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                (x, n), (y, m) = (_profiles(b.column(i).to_pylist()) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(_possible(x, y, n, m, percent)))

    return scratch.saved(_beside(pairs, profiles, "profile").mapInArrow(run, "a bigint, b bigint").distinct(), "likely")


def _verified(likely: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; texts move, which compress where digests don't."""

    def run(batches):
        kept("verify")
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):  # sets of one pair at a time are held
                x, y = (bytes_of(batch.column(c).slice(i, 1))[0] for c in (2, 3))
                if y != last[0]:  # pairs come sorted by b
                    last = (y, sets_of([y], k)[0][0])
                x, y = sets_of([x], k)[0][0], last[1]
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    nodes = scratch.saved(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "nodes")
    return scratch.saved(_beside(likely, _texts(docs, nodes), "text").mapInArrow(run, "a bigint, b bigint").distinct(), "links")


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of at most LISTED entries as rows; gaps differ from every row's entries and gaps."""
    offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    lens = np.diff(offsets)
    out, used = np.zeros((len(lens), LISTED), np.int64), np.arange(LISTED) < lens[:, None]
    out[used] = np.unique(flat, return_inverse=True)[1] + 1
    out[~used] = -1 - np.arange(np.count_nonzero(~used))
    return out


def _met_before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of two padded tables, pair by pair, share an entry."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), 16_384):
        part = slice(at, at + 16_384)
        out[part] = (x[part, :, None] == y[part, None, :]).any((1, 2))
    return out


def _meetings(unit: np.ndarray, node: np.ndarray, lesser: np.ndarray, visits: np.ndarray, small: np.ndarray):
    """Pairs of places (i, j) of sorted units that are to be compared, some thousands at a time; one of each pair is lesser.

    Units of one block hold residents only, and each two of them meet (in brief units by their
    distance in the order); elsewhere visitors meet residents.  Of two lesser ones the smaller id comes first.
    """
    start = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    length = np.diff([*start, len(unit)])
    brief = np.repeat(length, length) <= 64
    place = np.flatnonzero(brief & small)
    for d in range(1, 64):
        i = place[: len(place) - d]
        j = place[d:]
        same = unit[i] == unit[j]
        if not same.any():
            break
        keep = same & (lesser[i] | lesser[j])
        if keep.any():
            yield i[keep], j[keep]
    for a, n in zip(start.tolist(), length.tolist()):
        if n <= 64 and small[a]:
            continue
        here = np.arange(a, a + n)
        if small[a]:
            one, two = here[lesser[here]], here
        else:
            one, two = here[visits[here]], here[~visits[here]]
        for at in range(0, len(one), 64):
            x = one[at : at + 64]
            i, j = np.nonzero(~lesser[two][None, :] | (node[x][:, None] < node[two][None, :]))
            yield x[i], two[j]


def _across(inside: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of one index entry in different components that the bound allows.

    An entry's documents reside in blocks of about BLOCK.  Documents outside the entry's main
    component (lesser ones) visit every block, in chunks of about BLOCK; a unit of work is a
    block and a chunk, and only allowed pairs leave it.  Where nearly all are in the main
    component, hardly anything is copied.  Of two lesser documents the smaller id visits.
    ``before`` has a document's listed entries that come before the entry at hand (the order:
    larger first, as counted in column ``c``, then by token); two documents that share one of them have met there.
    """
    n = partitions(inside.sparkSession)
    sized = inside.withColumn("entry", F.struct((-F.col("c")).alias("c"), "token"))
    # a document's entries are at most the tokens of its own prefix
    lists = sized.filter(F.col("c") >= LISTED_FROM).groupBy("node").agg(F.slice(F.sort_array(F.collect_set("entry")), 1, LISTED).alias("listed")).filter(F.size("listed") > 1)
    rows = sized.join(profiles, "node").join(lists, "node", "left")
    earlier = F.transform(F.filter("listed", lambda e: e < F.col("entry")), lambda e: e["token"])
    rows = rows.withColumn("before", F.coalesce(earlier, F.array().cast("array<bigint>")))
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("chunks", F.ceil(F.col("fewer") / BLOCK).cast("int"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    spots = lambda n, make: F.transform(every(n), make)
    stay = spots("chunks", lambda v: F.struct(F.lit(False).alias("visits"), place("blocks").alias("o"), v.alias("v")))
    go = spots("blocks", lambda o: F.struct(F.lit(True).alias("visits"), o.alias("o"), place("chunks").alias("v")))
    goes = (F.col("comp") != F.col("main")) & (F.col("blocks") > 1)  # in an entry of one block all meet without visits
    rows = rows.withColumn("spot", F.explode(F.when(goes, F.concat(stay, go)).otherwise(stay))).withColumn("small", F.col("blocks") == 1)
    rows = rows.select("node", "size", "comp", (F.col("comp") != F.col("main")).alias("lesser"), "profile", "before", "small", "spot.visits", F.xxhash64("token", "spot.o", "spot.v").alias("unit"))
    met = rows.repartition(n, "unit").sortWithinPartitions("unit")

    def run(batches):
        kept("across")
        for part in whole_units(batches):
            node, size, comp, unit = (part.column(c).to_numpy() for c in ("node", "size", "comp", "unit"))
            lesser, visits, small = (part.column(c).to_numpy(zero_copy_only=False) for c in ("lesser", "visits", "small"))
            p, true = _profiles(part.column("profile").to_pylist())
            before = _padded(part.column("before"))
            for i, j in _meetings(unit, node, lesser, visits, small):
                ok = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
                i, j = i[ok], j[ok]
                for at in range(0, len(i), 16_384):
                    x, y = i[at : at + 16_384], j[at : at + 16_384]
                    ok = _possible(p[x], p[y], true[x], true[y], percent)
                    x, y = x[ok], y[ok]
                    new = ~_met_before(before[x], before[y])
                    a, b = node[x[new]], node[y[new]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def link(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row; two documents link when
    100 * |intersection| >= percent * |union| of their sets of k-word shingles."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        return saved(_linked(docs, k, percent, scratch), "linked")


def _copies(features: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): documents with the words of a smaller id b."""
    known = features.filter("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("b"), F.count("*").alias("c")).filter("c > 1")
    classes = scratch.saved(classes, "classes")
    total = classes.agg(F.sum("c")).first()[0] or 0
    return scratch.saved(spread_join(known.select("key", F.col("doc_id").alias("a")), classes, "key", "c", total).select("a", "b").filter("a <> b"), "copies")


def _linked(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    first = scratch.saved(_features(docs, k), "features")
    features = first.filter("cut IS NULL").select("doc_id", "n", "key")
    rows = features.count()
    shared = spark.sparkContext.broadcast(Order(_summed(first.filter("cut IS NOT NULL")), max(SALT_ROWS, rows // 1024)))
    copies = _copies(features, scratch)

    # one document indexes each class; an id with several rows keeps them all
    several = features.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("a"))
    spare = scratch.saved(copies.select("a").distinct().join(several, "a", "left_anti"), "spare")
    once = docs.join(F.broadcast(spare), docs["doc_id"] == spare["a"], "left_anti") if spare.count() <= BROADCAST_IDS else docs

    # index entries with two documents at least: rare shingles alone, frequent ones in pairs
    single = scratch.saved(_entered(_index(once, k, percent, shared), percent), "single")
    rare = f"salt = 0 AND c <= {FREQUENT}"
    paired = scratch.saved(_entered(_combinations(single.filter(f"NOT ({rare})").select(*_NAMES), percent, shared), percent), "paired")
    entries = single.filter(rare).union(paired)
    pair = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b")
    # the least documents of an entry's salts: as many as salts
    heads = paired.filter("salt > 0").groupBy("token", "salt").agg(F.min(F.struct("node", "size")).alias("h"))
    least = heads.groupBy("token").agg(F.min("h").alias("top"))
    across = heads.join(least, "token").filter(_close(F.col("h.size"), F.col("top.size"), percent)).select(F.col("h.node").alias("node"), F.col("top.node").alias("head"))
    tried = pair(entries.filter("prev IS NOT NULL"), "prev", "node").union(pair(entries.filter("head IS NOT NULL"), "head", "node")).union(pair(across, "head", "node"))
    tried = scratch.saved(tried.distinct(), "tried")
    profiles = scratch.saved(first.filter("cut IS NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "profile").distinct(), "profiles")
    links = _verified(_bounded(tried, profiles, percent, scratch), docs, k, percent, scratch)

    # pairs of an entry that are not in one component yet
    so_far = components(links.union(copies), into=scratch).withColumnRenamed("component", "comp")
    placed = entries.select("token", "node", "size").join(so_far, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = scratch.saved(placed.select("token", "node", "size", "comp").distinct(), "placed")
    per = placed.groupBy("token", "comp").agg(F.count("*").alias("c"))
    most = F.max(F.struct("c", "comp"))
    mixed = per.groupBy("token").agg(most.alias("most"), F.count("*").alias("comps"), F.sum("c").alias("c")).filter("comps > 1")
    mixed = scratch.saved(mixed.select("token", F.col("most.comp").alias("main"), "c", (F.col("c") - F.col("most.c")).alias("fewer")), "mixed")
    total = mixed.agg(F.sum("c")).first()[0] or 0
    inside = scratch.saved(spread_join(placed, mixed, "token", "c", total), "inside")
    more = scratch.saved(_across(inside, profiles, percent).join(tried, ["a", "b"], "left_anti"), "more")
    links = links.union(_verified(more, docs, k, percent, scratch))
    comps = components(links.union(copies), into=scratch).withColumnRenamed("node", "doc_id")
    out = features.join(comps, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
