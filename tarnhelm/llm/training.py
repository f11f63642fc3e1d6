"""Rows to learn from: a hash decides which documents are held out, another which are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
#: Distinct label values that can be learned; more are an error.
MOST_LABELS = 1000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


def sampled(rows: DataFrame, label: str, bound: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """At most about ``bound`` rows of each label value, by a hash of the key; and each value's rate.

    More than MOST_LABELS values raise: they are counted, never gathered."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"column {label} has more than {MOST_LABELS} values")
    scale = 1 << 30
    keep = {v: min(scale, scale * bound // n) for v, n in counts.items()}
    if not keep:
        return rows.limit(0), {}
    table = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
    drawn = F.pmod(F.xxhash64(F.lit("train"), F.col(key)), F.lit(scale)) < F.element_at(table, F.col(label))
    return rows.filter(drawn), {v: k / scale for v, k in keep.items()}
