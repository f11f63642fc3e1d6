"""Operator 10: WARC records in a content-addressed archive.

``archive`` keeps two tables.  ``payloads`` holds each distinct payload once, under its
SHA-256, with how many records carry it; equality of all payloads with one digest is
verified byte by byte before it is stored.  ``records`` holds the exact header bytes of
every record, the digest of its payload and whether it is a revisit.  ``records_of`` joins
them back to the original records: header, payload (none in a revisit record, which fetches
none) and the closing line ends.  ``parse`` reads records.

A digest with very many pages is split off from every join (see ``spread_join``); only short
payloads are carried by more than one record, so what is broadcast for them is small.

Of pages with equal payloads of at least ``revisit_from`` bytes, the one with the smallest
id is the response and the others are revisits that refer to it; shorter payloads are
responses always.

Defined results: a null html is the empty payload; payloads of any length are kept whole; a
null url gives a record without a target, and line ends in a url become %0D and %0A, since
they would end the header line; repeated rows make a record each: of rows that share the smallest id one is the
response (by url, then any) and the rest revisit that id; rows without an id come last; an
empty table gives an empty archive.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnhelm.llm.common import delete, spread_join
from tarnhelm.session import scratch_path

CRLF = "\r\n"
_URN = "urn:uuid:"


def _record_id(*what: Column) -> Column:
    """A record id, unique in its archive: digest digits in the form of a UUID."""
    h = F.sha2(F.concat_ws("|", *what), 256)
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit(_URN), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]))


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_from: int = 100, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write the archive below ``path``; payloads move once, by digest, and combine before they do."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.replace(F.replace(F.col(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    # one row a digest and task crosses the shuffle; min and max differ if a digest had two payloads
    store = rows.groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"), F.count("*").alias("n"))
    carried = F.when(F.octet_length("payload") >= revisit_from, 1).otherwise(F.col("n")).alias("carried")
    sure = F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one digest")))
    store.select("digest", sure.alias("payload"), carried).write.parquet(f"{path}/payloads")
    heads = rows.select("page_id", "url", "digest", "bytes", F.monotonically_increasing_id().alias("row"))
    heads.write.parquet(f"{path}/heads")
    spark = pages.sparkSession
    heads = spark.read.schema(heads.schema).parquet(f"{path}/heads")
    pick = F.struct(F.col("page_id").isNull().alias("late"), "page_id", F.coalesce("url", F.lit("")).alias("url"), "row")
    groups = heads.filter(F.col("bytes") >= revisit_from).groupBy("digest").agg(F.min(pick).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"), "n").write.parquet(f"{path}/groups")
    groups = spark.read.schema("digest string, first_id bigint, first_row bigint, n bigint").parquet(f"{path}/groups")
    j = spread_join(heads, groups, "digest", "n", heads.count(), "left")
    revisit = F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    uid = lambda pid, row: _record_id(pid.cast("string"), row.cast("string"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<"), uid(F.col("page_id"), F.col("row")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), uid(F.col("first_id"), F.col("first_row")), F.lit(">")))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("X-Refers-To-Page-ID", F.when(revisit, F.col("first_id").cast("string"))),
        _line("X-Payload-Length", F.col("bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    j.select("digest", F.encode(head, "UTF-8").alias("header"), revisit.alias("revisit")).write.parquet(f"{path}/records")
    delete(spark, f"{path}/heads", f"{path}/groups")
    return path


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """digest, record, payload: every original record byte for byte, rebuilt by joining headers to the store.

    A revisit's payload is null: it is that of the record it refers to.  Of the others the
    digest is verified as the payload is read; one that is gone or altered raises.
    """
    records = spark.read.schema("digest string, header binary, revisit boolean").parquet(f"{path}/records")
    store = spark.read.schema("digest string, payload binary, carried bigint").parquet(f"{path}/payloads")
    plain = records.filter("NOT revisit")
    sure = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload is missing or altered: "), F.col("digest"))))
    whole = spread_join(plain, store, "digest", "carried", plain.count(), "left").select("digest", "header", sure.alias("payload"))
    j = whole.unionByName(records.filter("revisit").select("digest", "header", F.lit(None).cast("binary").alias("payload")))
    return j.select("digest", F.concat("header", F.coalesce("payload", F.lit(b"")), F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"), "payload")


def _field(name: str) -> Column:
    got = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1)
    return F.when(got != "", got)


def parse(records: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes, body: read from the record bytes alone.

    A response whose body doesn't have the digest of its header raises.
    """
    raw = F.col("record")
    # a cast reads bytes as they are, and the search ends at the first empty line
    h = records.withColumn("header", F.substring_index(raw.cast("string"), CRLF * 2, 1)).withColumn("rest", F.octet_length("header") + 5)
    kind, digest = _field("WARC-Type"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "")
    body = raw.substr(F.col("rest"), _field("Content-Length").cast("int"))
    out = h.select(
        _field("X-Page-ID").cast("bigint").alias("page_id"), _field("WARC-Target-URI").alias("url"), kind.alias("record_type"),
        _field("X-Refers-To-Page-ID").cast("bigint").alias("refers_to"), digest.alias("payload_digest"),
        _field("X-Payload-Length").cast("bigint").alias("payload_bytes"), body.alias("body"),
    )
    sound = (F.col("record_type") == "revisit") | (F.sha2("body", 256) == F.col("payload_digest"))
    return out.withColumn("payload_digest", F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a body doesn't have its record's digest"))))


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Archive the pages, read the archive back, and parse every record."""
    spark = pages.sparkSession
    return parse(records_of(spark, archive(pages, path or scratch_path(spark, "warc"), **options)))
