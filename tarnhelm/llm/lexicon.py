"""Operator 1: byte-pair encoding through a minimal acyclic transducer, and decoding.

Frequent words of the corpus, with the ids they encode to, are compiled into a minimal
acyclic automaton that shares prefixes and suffixes.  Its arcs carry additive outputs, so
the sum along a word's path is the word's place in byte order, which leads to its ids.
The compiled file lies in the shared folder, is handed to every executor once and
memory-mapped by its workers (one copy of pages for all of them).  Words outside the lexicon are merged exactly, so the
lexicon changes speed only, never ids.

Defined results: null and empty texts have no ids and decode to the empty text; repeated
rows are encoded each for itself; an empty table gives an empty table; a column with the
name of a result is replaced, any other passes through; texts of any length are encoded
whole, in pieces.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.llm.bpe import Bpe, Encoder, bpe_of
from tarnhelm.llm.common import Scratch, add_columns, binary_rows, kept, pieces, slices, texts_of
from tarnhelm.session import scratch_path

#: Words in the lexicon: a limit on its size, not on what is encoded.
LEXICON_WORDS = 50_000
_MAGIC = b"MATL0001"


class _State:
    __slots__ = ("final", "arcs", "number", "count")

    def __init__(self):
        self.final, self.arcs, self.number, self.count = False, [], -1, 0


def _minimal(words: Sequence[bytes]) -> list[_State]:
    """States of the minimal acyclic automaton of sorted distinct words; the start state is the last."""
    register: dict[tuple, _State] = {}
    order: list[_State] = []

    def settle(s: _State) -> _State:
        sign = (s.final, tuple((label, t.number) for label, t in s.arcs))
        known = register.get(sign)
        if known is None:
            s.number, s.count = len(order), s.final + sum(t.count for _, t in s.arcs)
            order.append(s)
            register[sign] = known = s
        return known

    path, last = [_State()], b""
    for w in words:
        same = 0
        while same < len(last) and same < len(w) and last[same] == w[same]:
            same += 1
        while len(path) > same + 1:
            done = path.pop()
            label, _ = path[-1].arcs[-1]
            path[-1].arcs[-1] = (label, settle(done))
        for byte in w[same:]:
            s = _State()
            path[-1].arcs.append((byte, s))
            path.append(s)
        path[-1].final, last = True, w
    while len(path) > 1:
        done = path.pop()
        label, _ = path[-1].arcs[-1]
        path[-1].arcs[-1] = (label, settle(done))
    settle(path[0])
    return order


def compile_lexicon(words: Sequence[bytes], bpe: Bpe, path: str) -> None:
    """Write the transducer of the words with their ids: a header of lengths, then flat arrays."""
    words = sorted({w for w in words if w})
    states = _minimal(words)
    key, target, out = [], [], []
    for s in states:
        before = int(s.final)
        for label, t in s.arcs:
            key.append(s.number << 8 | label)
            target.append(t.number)
            out.append(before)
            before += t.count
    ids, bounds = bpe.merge(words)
    arrays = [np.array(key, "<i8"), np.array(target, "<i4"), np.array(out, "<i4"), np.array([s.final for s in states], "u1"), bounds.astype("<i8"), ids.astype("<i4")]
    with open(path, "wb") as f:
        f.write(_MAGIC + np.array([max(map(len, words), default=0), *map(len, arrays)], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        raw = np.memmap(path, "u1", "r")
        if raw[:8].tobytes() != _MAGIC:
            raise ValueError("not a lexicon file")
        head = raw[8:64].view("<i8")
        self.longest, at, parts = int(head[0]), 64, []
        for n, kind in zip(head[1:], ("<i8", "<i4", "<i4", "u1", "<i8", "<i4"), strict=True):
            size = int(n) * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind))
            at += size + (-size % 8)
        self.key, self.target, self.out, self.final, self.bounds, self.ids = parts
        self.start = len(self.final) - 1

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't in the lexicon; all words walk together."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        place = np.full(len(words), -1, np.int64)
        live = np.flatnonzero((lens > 0) & (lens <= self.longest))
        if not len(live) or not len(self.key):
            return place
        raw = np.frombuffer(b"".join([words[i].ljust(self.longest, b"\0") for i in live]), np.uint8).reshape(len(live), self.longest)
        state, total, size = np.full(len(live), self.start, np.int64), np.zeros(len(live), np.int64), lens[live]
        for i in range(self.longest):
            want = state << 8 | raw[:, i]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            ok = self.key[arc] == want
            live, raw, size, arc = live[ok], raw[ok], size[ok], arc[ok]
            state, total = self.target[arc].astype(np.int64), total[ok] + self.out[arc]
            end = size == i + 1
            if end.any():
                hit = end & (self.final[state] == 1)
                place[live[hit]] = total[hit]
                live, raw, size, state, total = (x[~end] for x in (live, raw, size, state, total))
            if not len(live):
                break
        return place

    def resolve(self, words: Sequence[bytes], bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words: by the transducer, the others merged."""
        place = self.find(words)
        missing = np.flatnonzero(place < 0)
        flat, bounds = bpe.merge([words[i] for i in missing])
        table = np.concatenate([self.ids, flat])
        ends = np.concatenate([self.bounds, bounds[1:] + self.bounds[-1]])
        row = place.copy()
        row[missing] = len(self.bounds) - 1 + np.arange(len(missing))
        lens = ends[row + 1] - ends[row]
        out = np.concatenate([[0], np.cumsum(lens)])
        return table[np.repeat(ends[row] - out[:-1], lens) + np.arange(out[-1])], out


def word_counts(docs: DataFrame, text: str, tokenizer: str, flush: int = 100_000) -> DataFrame:
    """(word BINARY, n) over all texts; counted in each task first, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("words")  # what an earlier encoding remembers would lie idle here
        bpe, seen = bpe_of(tokenizer), Counter()

        def out():
            words = [w.encode("utf-8") for w in seen if isinstance(w, str)]
            n = [k for w, k in seen.items() if isinstance(w, str)]
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()), pa.array(n[a : a + 50_000], pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, text):
                for t in texts_of(part.column(0)):
                    for p in pieces(t):
                        seen.update(bpe.words(p))
                        if len(seen) > flush:
                            yield from out()
        yield from out()

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, tokenizer: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of the corpus and hand the file to the executors; returns its name.

    Counts fall into steps of a 32nd of a doubling; the highest steps that together have at
    most ``size`` words are taken, so only those words come to the driver.
    """
    spark = docs.sparkSession
    step = F.floor(F.log2("n") * 32)
    with Scratch(spark) as scratch:
        counts = scratch.saved(word_counts(docs, text, tokenizer).filter("n > 1").withColumn("step", step), "word-counts")
        least, total = None, 0
        for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # 32 a doubling: some 2000 at most
            total += r["count"]
            if total > size:
                break
            least = r["step"]
        top = [] if least is None else counts.filter(F.col("step") >= least).select("word").collect()
    # the file goes to the shared folder, from where executors fetch it, replaced ones too; the driver's own copy goes
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    shared = f"{scratch_path(spark, 'lexicon')}/{name}"
    with tempfile.TemporaryDirectory(prefix="lexicon-") as folder:
        compile_lexicon([bytes(r["word"]) for r in top], bpe_of(tokenizer), os.path.join(folder, name))
        path = spark._jvm.org.apache.hadoop.fs.Path
        path(shared).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path("file://" + os.path.join(os.path.realpath(folder), name)), path(shared))
    spark.sparkContext.addFile(shared)
    return name


def _encoder(tokenizer: str, name: str) -> Encoder:
    mine = kept("lexicon")
    if name not in mine:
        mine.clear()
        bpe, lexicon = bpe_of(tokenizer), Lexicon(SparkFiles.get(name))
        mine[name] = Encoder(bpe, remember=120_000, resolve=lambda words: lexicon.resolve(words, bpe))
    return mine[name]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", lexicon: str | None = None, size: int = LEXICON_WORDS) -> DataFrame:
    """Append ``ids``: the token ids as little-endian unsigned 32-bit integers (BINARY).

    ``lexicon`` is a name from ``build_lexicon``; by default one is built from these texts.
    """
    lexicon = lexicon or build_lexicon(docs, text, tokenizer, size)

    def make():
        encoder = _encoder(tokenizer, lexicon)

        def f(col: pa.Array) -> list[pa.Array]:
            flat, bounds = encoder.encode(texts_of(col))
            return [binary_rows(flat.astype("<u4"), bounds)]

        return f

    return add_columns(docs, text, [T.StructField(ids, T.BinaryType())], make)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Append ``text``: the tokens' bytes joined and read as UTF-8; malformed bytes become U+FFFD. Null ids give null."""

    def make():
        table = bpe_of(tokenizer).token_bytes.__getitem__

        def one(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            ids = np.frombuffer(raw, "<u4")
            return b"".join([b"".join(map(table, ids[a : a + 65_536].tolist())) for a in range(0, len(ids), 65_536)]).decode("utf-8", "replace")

        return lambda col: [pa.array([one(x) for x in col.to_pylist()], pa.string())]

    return add_columns(df, ids, [T.StructField(text, T.StringType())], make)
