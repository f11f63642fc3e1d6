"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.catalog import load
from tarnhelm.llm import ann, itq, jaccard, langid, lexicon, packing, sharding, token_store, toxicity, warc
from tarnhelm.llm.training import held_out
from tarnhelm.session import scratch_path


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = lexicon.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), path)
    back = lexicon.decode(coded.select("doc_id", "ids"), path)
    return back.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_path(spark, "token-store")
    token_store.write_store(load(spark, sf_dir, "documents"), at, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, at).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "embeddings")
    return ann.search(df, df.filter("vec_id % 20 = 0"))


def op4_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.link(load(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    carry = {"doc_id": F.col("doc_id"), "size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text.cast("binary"))}
    placed = sharding.shard(load(spark, sf_dir, "documents"), 8, carry=carry)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(load(spark, sf_dir, "documents"), k=3, percent=90)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_store, op3_ann, op4_itq, op5_packing, op6_toxicity, op7_sharding, op8_langid, op9_jaccard, op10_warc)}

_REACH = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)"""

#: The remainders of CRC-32 by half a byte.
_CRC = [functools.reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), i) for i in range(16)]


def _crc32_sql(raw: str) -> str:
    """CRC-32 of the bytes that a column holds in hex."""
    half = lambda c: f"xor({c} >> 4, ({_CRC}::BIGINT[])[({c} & 15) + 1])"
    bytes_ = f"list_transform(range(0, length({raw}) // 2), lambda i: CAST('0x' || substr({raw}, 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


ORACLES: dict[str, str] = {
    "op4_itq": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true) AND list_dot_product(e, e) > 0),
        link AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id
                 WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
        nodes AS (SELECT id FROM v), {_REACH},
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT reach.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(reach.b) AS component_id, reach.a = min(reach.b) AS kept
        FROM reach LEFT JOIN n ON n.a = reach.a GROUP BY reach.a""",
    "op7_sharding": f"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw, source, sha256(concat_ws(chr(31), '42', CAST(doc_id AS VARCHAR), coalesce(text, chr(0)))) AS key FROM documents),
        r AS (SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY key) AS DOUBLE) - 0.5::DOUBLE) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS frac FROM d),
        p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, key) - 1 AS pos, count(*) OVER () AS n FROM r),
        s AS (SELECT *, CAST((SELECT max(x) FROM range(8) t(x) WHERE (x * n + 7) // 8 <= pos) AS INTEGER) AS shard FROM p)
        SELECT doc_id, CAST(length(raw) // 2 + 1 AS BIGINT) AS size, {_crc32_sql('raw')} AS text_crc32, 'rows' AS law, shard, CAST(pos - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op9_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        t AS (SELECT id, len(s) AS n, unnest(s) AS t FROM s),
        duo AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM t x JOIN t y ON x.t = y.t AND x.id <> y.id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY x.id, y.id),
        link AS (SELECT a, b FROM duo WHERE 100 * c >= 90 * (n + m - c)),
        nodes AS (SELECT id FROM s), {_REACH}
        SELECT s.id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM s JOIN reach ON reach.a = s.id GROUP BY s.id, s.s""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM q""",
}
