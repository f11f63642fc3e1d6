"""Corpus pipeline: toxicity, language, near duplicates, packing; each stage is written and read by the next.

Defined results of every stage: all but the last return the columns of their documents, in
their order and with their values, whatever the columns are called; an empty table gives an
empty table; texts of any length are read whole; rows that repeat an id and rows without one
are treated each as its stage says.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.catalog import load
from tarnhelm.llm import jaccard, langid, packing, toxicity
from tarnhelm.llm.common import delete, fresh, saved
from tarnhelm.session import scratch_path

#: Least support (share of words with a known word or 4-gram) of a document in a learned language.
SUPPORT = 0.4


def _filtered(docs: DataFrame, added: tuple[str, ...], mark: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """Rows that ``keep`` holds for after ``mark``; columns named like the ones it adds step aside and come back."""
    names: dict[str, str] = {}
    for c in docs.columns:
        names[c] = fresh([*added, *docs.columns, *names.values()], f"{c}_") if c.lower() in added else c
    aside = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return mark(aside).filter(keep).select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go.

    Each row is judged by its own text; null and empty texts have no evidence and stay, as
    does everything if labels of both classes are missing.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return _filtered(docs, ("score", "predicted", "toxic_spans"), lambda d: toxicity.score(d, model), "predicted = 0")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null, empty and letterless texts, texts between two
    languages (score below a half), and texts whose words no language knows (support below SUPPORT).

    Each row is judged by its own text; without any document to learn from all go.
    """
    model = langid.fit(docs)
    return _filtered(docs, ("lang_pred", "score", "support"), lambda d: langid.predict(d, model), f"lang_pred <> 'und' AND score >= 0.5 AND support >= {SUPPORT}")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays.

    Rows that repeat an id are one document and stay or go together; rows without an id, and
    texts without words, are in no group and stay.  The ids that go are broadcast while they
    are few (counted first), so that texts stay where they are.
    """
    extra = saved(jaccard.link(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "extra")
    if extra.count() <= jaccard.BROADCAST_IDS:
        extra = F.broadcast(extra)
    return docs.join(extra, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents in sequences of at most 2048 tokens; null and empty texts are the end id alone, repeated rows are packed each."""
    # executors have grown in the stages before: a smaller memory of words here
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=200_000)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("language_id", keep_identified), ("jaccard_join", drop_near_copies), ("packing", pack_sequences)]
#: Learned scores and tokenizer ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted when the next one is written."""
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            delete(spark, last)
        last = at
    return docs
