"""Operator 8: language identification, words first.

A word that any language knows is scored by its log frequency in each; a word that none
knows is scored by its character 4-grams (of the word between boundary marks), and if none
of those is known by its 3-grams, then 2-grams, then letters.  A text's languages compete
by the sum over its words; the score is the winner's share after a softmax.  ``support`` is
the share of words that are known or hold a known 4-gram: a text of another language, or of
random letters, has little of it however sure the softmax is.

At most ``per_lang`` documents of a language are learned from (more than 1000 languages are
an error).  A word or n-gram is known when they hold it ``min_count`` times, all languages
together; what is known is counted in each of them.  So the model's size is bounded by the
sampled texts, and nothing that is seen often enough is left out.  Only the text is ever an
input of a prediction.

Words are runs of letters; other characters, digits and signs like the one in ``m2`` or a
raised 2, only part them.

Defined results: ``und`` with score and support 0 for a null text, a text without a letter,
and when nothing could be learned; ties go to the language first in order; texts of any
length are read whole; repeated rows are predicted each; columns named like a result are
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnhelm.llm.common import Scratch, add_columns, kept, pieces, slices, texts_of
from tarnhelm.llm.training import held_out, sampled

PER_LANG, MIN_COUNT, LONGEST = 2_000, 8, 4
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    out = []
    for w in _WORD.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:  # numerals that aren't digits stand inside
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """``table``: (kind, text) -> one log probability a language; kind 0 is words, n is n-grams."""

    REMEMBER = 300_000

    def __init__(self, langs: list[str], table: dict[tuple[int, str], np.ndarray]):
        self.langs, self.table = langs, table
        self._rows: dict[str, int] = {}
        self._scores: list[np.ndarray] = []
        self._matrix = np.zeros((0, len(langs) + 1))

    def word(self, w: str) -> np.ndarray:
        """Its score in each language, and whether it is known as a word or by a 4-gram."""
        hit = self.table.get((0, w))
        if hit is not None:
            return np.append(hit, 1.0)
        for n in range(LONGEST, 0, -1):
            known = [x for g in grams(w, n) if (x := self.table.get((n, g))) is not None]
            if known:
                return np.append(np.sum(known, axis=0) / n, float(n == LONGEST))  # overlapping n-grams see each letter n times
        return np.zeros(len(self.langs) + 1)

    def _learn(self, words: list[str]) -> None:
        if len(self._rows) > self.REMEMBER:
            keep = self.REMEMBER // 3
            self._rows = dict(islice(self._rows.items(), keep))
            self._matrix = self._matrix[:keep].copy()
        new = [w for w in dict.fromkeys(words) if w not in self._rows]
        if new:
            for i, w in enumerate(new, len(self._rows)):
                self._rows[w] = i
            self._matrix = np.concatenate([self._matrix, np.array([self.word(w) for w in new])])

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, support) of each text."""
        if not self.langs:
            return [("und", 0.0, 0.0)] * len(texts)
        sums, counts = np.zeros((len(texts), len(self.langs) + 1)), [0] * len(texts)
        block: list[tuple[int, list[str]]] = []

        def flush() -> None:
            self._learn([w for _, ws in block for w in ws])
            get = self._rows.__getitem__
            for i, ws in block:
                sums[i] += self._matrix[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0)
                counts[i] += len(ws)
            block.clear()

        held = 0
        for i, t in enumerate(texts):
            for p in pieces(t):
                if ws := words_of(p):
                    block.append((i, ws))
                    held += len(ws)
                    if held > 100_000:
                        flush()
                        held = 0
        flush()
        out = []
        for (*s, known), n in zip(sums, counts):
            i = int(np.argmax(s))
            out.append((self.langs[i], float(1 / np.exp(np.maximum(np.array(s) - s[i], -700)).sum()), float(known / n)) if n else ("und", 0.0, 0.0))
        return out


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])
                seen.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for t, lang in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                    for p in pieces(t):
                        seen.update((lang, w) for w in words_of(p))
                if len(seen) > 200_000:
                    yield from out()
        yield from out()

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _gram_counts(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, w, k in zip(*(c.to_pylist() for c in batch.columns)):
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        seen[lang, n, g] += k
            if seen:
                lang, n, g = zip(*seen)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(g, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "kind", "item", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, kind int, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", per_lang: int = PER_LANG, min_count: int = MIN_COUNT) -> Model:
    """Learn from documents with a language that are not held out."""
    rows = docs.filter(F.col(lang).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    chosen, rates = sampled(rows.select("doc_id", "lang", "text"), "lang", per_lang)
    langs = sorted(rates)
    with Scratch(docs.sparkSession) as scratch:
        words = scratch.saved(_word_counts(chosen), "lang-words")
        items = scratch.saved(words.select("lang", F.lit(0).alias("kind"), F.col("word").alias("item"), "n").union(_gram_counts(words)), "lang-items")
        # a row for each known item, with its counts by language; and a total for each language and kind
        known = items.groupBy("kind", "item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).filter(F.col("all") >= min_count)
        counts = {(r["kind"], r["item"]): r["by"] for r in known.select("kind", "item", "by").toLocalIterator()}
        totals = {(r["lang"], r["kind"]): r["n"] for r in items.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    kinds = Counter(kind for kind, _ in counts)
    # half a count for what a language hasn't shown
    rest = {kind: np.array([totals.get((x, kind), 0) + 0.5 * n for x in langs]) for kind, n in kinds.items()}
    table = {(kind, item): np.log(np.array([by.get(x, 0) + 0.5 for x in langs]) / rest[kind]) for (kind, item), by in counts.items()}
    return Model(langs, table)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``score`` and ``support``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table))

    def make():
        m = _model(shared.value)

        def f(col: pa.Array) -> list[pa.Array]:
            got = m.predict(texts_of(col))
            return [pa.array([x[0] for x in got], pa.string()), *(pa.array([x[i] for x in got], pa.float64()) for i in (1, 2))]

        return f

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("support", T.DoubleType())]
    return add_columns(docs, text, fields, make)


def _model(parts) -> Model:
    """One in a worker: what it has worked out about words stays between tasks."""
    mine = kept("langid")
    if mine.get("parts") is not parts:
        mine.update(parts=parts, model=Model(*parts))
    return mine["model"]
