"""Operator 6: toxic passages by maximum-scoring segment search.

A word's score is its log-odds between toxic and clean training documents (in how many of
them it occurs), both smoothed with a Dirichlet prior in the proportions of all training
documents.  Words whose log-odds are ``min_delta`` from zero at least, and ``min_z`` standard
deviations, keep their score (held between LEAST and MOST).  A word that doesn't takes that of its surest run of five
characters (of the word between boundary marks), so that inflected forms count; every word
without any gets the (negative) log ratio of what is left of either distribution.  A text
is scanned once, in linear time, for all its maximal segments: the disjoint runs of words
whose score no shorter or longer run beats.

Segments are calibrated as extreme values.  With ``rate`` the root of E[exp(rate * s)] = 1
over clean words and ``k`` fitted to the best segments of clean documents, a segment of
score S in n words has the E-value k n exp(-rate S).  The significant segments of a text
are aggregated by the sum of their normalised scores, whose tail is known for r segments
at once; the most surprising r is the text's evidence.  A logistic curve, fitted to training
documents, turns it into a probability.

At most ``per_class`` labelled rows of either class are learned from.  Labels, languages,
sources and ids are never inputs of a score.

Defined results: null and empty texts have no evidence and get the base score; a document
without labels, or with label 1 anywhere among repeated labels, is clean or toxic in
training accordingly (unlabelled rows don't train); without both classes every score is 0;
repeated rows are scored each; texts of any length are scanned whole; columns named like a
result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.llm.common import Scratch, add_columns, kept, pieces, slices, texts_of
from tarnhelm.llm.training import held_out, sampled

PER_CLASS = 20_000
_WORD = re.compile(r"[^\W_]+")


#: Log-odds are held between these, so that one word is never all of the evidence.
LEAST, MOST = -3.0, 8.0
GRAM, MARK = 5, "~"  # a run of characters is kept as the mark (never in a word) and the run


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [MARK + w[i : i + GRAM] for i in range(len(w) - GRAM + 1)]


class _Scores(dict):
    """Word to score (None: no score of its own); what it works out it keeps, up to a bound."""

    def __init__(self, table: dict[str, tuple[float, float]]):
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> float | None:
        hit = self.table.get(word) or max((x for g in grams_of(word) if (x := self.table.get(g))), key=lambda x: abs(x[1]), default=None)
        if len(self) > 400_000:
            self.clear()
        out = self[word] = hit[0] if hit else None
        return out


def maximal_segments(at: Sequence[int], scores: Sequence[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in linear time.

    ``at`` and ``scores`` give the positions with a score of their own, in order; every
    other position scores ``-drift``.  Candidates form chains: each knows the nearest
    earlier one that starts lower, so none is looked at twice in vain.
    """
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []  # total before the candidate
    high: list[float] = []  # total at its end
    back: list[int] = []  # nearest earlier candidate with a smaller total before it
    total, place = 0.0, 0
    for p, s in zip(at, scores, strict=True):
        total -= drift * (p - place)
        place = p + 1
        if s <= 0:
            total += s
            continue
        a, lo, total = p, total, total + s
        j = len(low) - 1
        while True:
            while j >= 0 and low[j] >= lo:
                j = back[j]
            if j < 0 or high[j] >= total:
                break
            a, lo = first[j], low[j]
            for x in (first, last, low, high, back):
                del x[j:]
            j -= 1
        first.append(a), last.append(p + 1), low.append(lo), high.append(total), back.append(j)
    return [(a, b, h - lo) for a, b, lo, h in zip(first, last, low, high, strict=True)]


@dataclass(frozen=True)
class Model:
    """``scores``: (log-odds, z) by word or run of characters; the drift of every other word, the
    extreme-value fit and the logistic curve."""

    scores: dict[str, tuple[float, float]]
    drift: float
    rate: float
    k: float
    intercept: float = -1000.0
    slope: float = 0.0
    e_value: float = 0.5

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments; a long text is read in pieces."""
        own, at, scores, n = _memory(self.scores).__getitem__, [], [], 0
        for p in pieces(text):
            words = words_of(p)
            for i, s in enumerate(map(own, words), n):
                if s is not None:
                    at.append(i)
                    scores.append(s)
            n += len(words)
        return n, maximal_segments(at, scores, self.drift)

    def significant(self, n: int, segments) -> list[tuple[int, int, float]]:
        """(first, last + 1, normalised score) of segments whose E-value is at most ``e_value``."""
        shift = math.log(max(self.k * max(n, 1), 1e-300))
        norm = [(a, b, self.rate * s - shift) for a, b, s in segments]
        return [x for x in norm if x[2] >= -math.log(self.e_value)]

    def evidence(self, n: int, segments) -> float:
        """-log of the least tail probability over the r best significant segments, for any r."""
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((x[2] for x in self.significant(n, segments)), reverse=True), 1):
            total += x
            tail = total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r)
            best = max(best, tail)
        return best

    def score(self, evidence: float) -> float:
        x = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _memory(table: dict) -> _Scores:
    """One in a worker, for the model at hand."""
    mine = kept("toxicity")
    if mine.get("table") is not table:
        mine.update(table=table, scores=_Scores(table))
    return mine["scores"]


def _counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of either class with the word or run; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def out():
            for y in (0, 1):
                if seen[y]:
                    n = pa.array(list(seen[y].values()), pa.int64())
                    zero = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen[y]), pa.string()), *([n, zero] if y else [zero, n])], names=["word", "toxic", "clean"])
                    seen[y].clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for t, y in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                    words = {w for p in pieces(t) for w in words_of(p)}
                    seen[y].update(words)
                    seen[y].update({g for w in words for g in grams_of(w)})
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield from out()
        yield from out()

    return rows.select("text", "y").mapInArrow(run, "word string, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1 (1 if the scores are log ratios)."""
    lo, hi = 1e-6, 1.0
    while (p * np.exp(np.minimum(hi * s, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Newton's method for intercept and slope, with a slight ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(60):
        z = np.clip(a + b * x, -30, 30)
        p = 1 / (1 + np.exp(-z))
        g = np.array([(w * (p - y)).sum(), (w * (p - y) * x).sum() + 1e-2 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, prior: float = 0.01, min_z: float = 2.3, min_delta: float = 3.0) -> Model:
    """Learn from labelled rows that are not held out.  The sampled ids are broadcast: 2 * per_class at most.

    Every significant word is kept; the words come from 2 * per_class documents at most."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    marks = marks.groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.max((F.col(label) == 1).cast("int")).alias("y"))
    with Scratch(docs.sparkSession) as scratch:
        return _fitted(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), marks, per_class, prior, min_z, min_delta, scratch)


def _fitted(base: DataFrame, marks: DataFrame, per_class: int, prior: float, min_z: float, min_delta: float, scratch: Scratch) -> Model:
    chosen, rates = sampled(marks, "y", per_class)
    if set(rates) != {0, 1}:
        return Model({}, 1.0, 1.0, 1.0)
    rows = scratch.saved(base.join(F.broadcast(chosen), "doc_id").select("text", "y"), "labelled")
    counts = scratch.saved(_counts(rows), "word-odds")
    # documents of either class, as the number of chances a word has to occur
    size = rows.groupBy("y").count().collect()
    nt, nc = (float(next((r["count"] for r in size if r["y"] == y), 0)) for y in (1, 0))
    if not nt or not nc:
        return Model({}, 1.0, 1.0, 1.0)
    alpha = prior * (F.col("toxic") + F.col("clean"))  # of prior * (nt + nc) imagined documents of each class
    t, c, more = F.col("toxic") + alpha, F.col("clean") + alpha, prior * (nt + nc)
    delta = F.log(t / (nt + more - t + 1)) - F.log(c / (nc + more - c + 1))
    odds = counts.select("word", "toxic", "clean", delta.alias("delta"), (delta / F.sqrt(1 / t + 1 / c)).alias("z"))
    odds = odds.filter((F.abs("z") >= min_z) & (F.abs("delta") >= min_delta))
    table = odds.collect()  # the significant words of the sampled documents
    if not table:
        return Model({}, 1.0, 1.0, 1.0)
    scores = {r["word"]: (min(max(r["delta"], LEAST), MOST), r["z"]) for r in table}

    def masses(batches):
        memory = _Scores(scores)
        for batch in batches:
            out: Counter = Counter()
            for x, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                for p in pieces(x):
                    out.update((y, memory[w]) for w in words_of(p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int64()), pa.array([s for _, s in out], pa.float64()), pa.array(list(out.values()), pa.int64())], names=["y", "s", "n"])

    # a row for each class and score: bounded by the significant words
    mass = rows.mapInArrow(masses, "y bigint, s double, n bigint").groupBy("y", "s").agg(F.sum("n").alias("n")).collect()
    words_in = {y: sum(r["n"] for r in mass if r["y"] == y) or 1 for y in (0, 1)}
    rest = {y: max(sum(r["n"] for r in mass if r["y"] == y and r["s"] is None) / words_in[y], 1e-3) for y in (0, 1)}
    drift = max(-math.log(rest[1] / rest[0]), 0.01)
    p = np.array([r["n"] / words_in[0] for r in mass if r["y"] == 0])
    s = np.array([-drift if r["s"] is None else r["s"] for r in mass if r["y"] == 0])
    # scores are log ratios, for which the rate is 1; clean words that never score leave it there
    rate = min(_root(p / p.sum(), s), 1.0) if len(p) and (s > 0).any() else 1.0
    model = Model(scores, drift, rate, 1.0)

    def best(batches):
        for batch in batches:
            out = []
            for x, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                m, seg = model.segments(x)
                out.append((y, m, max((s for *_, s in seg), default=0.0)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["y", "n", "best"])

    clean = rows.filter("y = 0").mapInArrow(best, "y bigint, n bigint, best double")
    fitted = clean.agg(F.count("*").alias("m"), F.sum(F.col("n") * F.exp(-rate * F.col("best"))).alias("s")).first()
    model = Model(model.scores, drift, rate, max(fitted["m"] / fitted["s"], 1e-9) if fitted["s"] else 1.0)

    def measure(batches):
        for batch in batches:
            out = [(y, model.evidence(*model.segments(x))) for x, y in zip(texts_of(batch.column(0)), batch.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in out], pa.int64()), pa.array([e for _, e in out], pa.float64())], names=["y", "e"])

    # a number for each sampled row: 2 * per_class at most
    pts = rows.mapInArrow(measure, "y bigint, e double").toPandas()
    y = pts["y"].to_numpy(float)
    a, b = _logistic(np.log1p(pts["e"].to_numpy(float)), y, np.where(y == 1, 1 / rates[1], 1 / rates[0]))
    return Model(model.scores, drift, rate, model.k, a, b)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``score``, ``predicted`` and ``toxic_spans``: the significant passages, as (start, end, score, words)
    with character places in the text."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def make():
        m = shared.value

        def f(col: pa.Array) -> list[pa.Array]:
            scores, spans = [], []
            for t in texts_of(col):
                n, seg = m.segments(t)
                scores.append(m.score(m.evidence(n, seg)))
                hit = m.significant(n, seg)
                # places hold in the text where lower-casing keeps its length
                ends = {x for a, b, _ in hit for x in (a, b - 1)}
                at = {i: w.span() for i, w in enumerate(_WORD.finditer(t.lower())) if i in ends} if hit else {}
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in hit])
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]

        return f

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.ArrayType(span))]
    return add_columns(docs, text, fields, make)
