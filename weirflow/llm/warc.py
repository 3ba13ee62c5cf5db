"""Content-addressed WARC archive.

An archive is two tables in one folder. ``payloads`` holds each distinct payload once under
its SHA-256; ``headers`` holds, for each record, the exact header bytes and the digest of the
payload they belong to. A record's original bytes are the join of the two. Nothing is trusted
on reading: a payload whose bytes do not hash to its key, or a header whose Content-Length
differs from the block it gets, raises.

Of records with equal payloads of at least ``min_bytes``, the one with the largest page_id is
``response`` and the others ``revisit`` it; smaller payloads are ``response`` always.

Defined results: null html is an empty payload; a null url is written as an empty target; equal
page_ids that tie for the largest are all responses; if a group's page_ids are all null,
all its records are responses; repeated rows give repeated records; a very long payload is one value, as in the
table; an empty table gives an empty archive; other columns are not kept and may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._common import checkpoint_path, cut, lookup

MIN_BYTES = 1000
#: Groups of copies are broadcast below this many rows of some 100 bytes.
BROADCAST_GROUPS = 50_000
CRLF = "\r\n"


def _digest(payload: Column) -> Column:
    return F.sha2(payload, 256)


def archive_path(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_path(spark)}/warc-{uuid.uuid4().hex}"


def _header(kind: Column) -> Column:
    """The exact header block of a record."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    ident = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        field("WARC-Type", kind),
        field("WARC-Record-ID", ident(F.col("page_id"))),
        # line breaks would end the field early
        field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                field("WARC-Refers-To", ident(F.col("first_id"))),
            ),
        ).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the archive of ``pages`` (page_id, url, html) into the folder ``path``."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    records = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    light = cut(
        records.select(
            "page_id", "url", _digest(F.col("payload")).alias("digest"), F.sha1("payload").alias("sha1"),
            F.octet_length("payload").cast("long").alias("bytes"),
        )
    )
    # groups of copies only: a payload that stands alone needs no join
    copies = light.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    groups = cut(copies)
    rows = groups.count()
    revisits = (F.col("bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))
    headed = lookup(light, groups, "digest", rows, "left", BROADCAST_GROUPS).withColumn("kind", kind)
    headed.select(
        "page_id", F.unhex("digest").alias("digest"), F.encode(_header(F.col("kind")), "UTF-8").alias("header")
    ).write.parquet(f"{path}/headers")

    # one record of each digest carries the payload; where groups are sent out, no payload moves for that
    carried = records.withColumn("digest", _digest(F.col("payload"))).select("digest", "payload", "page_id")
    marked = lookup(carried, groups, "digest", rows, "left", BROADCAST_GROUPS)
    first = F.col("copies").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    stored = marked.where(F.col("copies").isNull() | first)
    if not light.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        # pages that share the largest id: one of them is taken
        stored = marked.where(F.col("copies").isNull()).union(marked.where(first).dropDuplicates(["digest"]))
    stored.select(F.unhex("digest").alias("digest"), "payload").write.parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: header bytes and block bytes as written, and the full payload.

    ``block`` is what follows the header in a WARC file; it is empty for a revisit.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    checked = stored.select(
        "digest",
        F.when(F.unhex(_digest(F.col("payload"))) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.hex("digest"))).cast("binary"))
        .alias("payload"),
    )
    headers = spark.read.parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    joined = headers.join(checked, "digest", "left").withColumn("revisit", field(text, "WARC-Type") == "revisit")
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    fits = F.octet_length(block).cast("string") == field(text, "Content-Length")
    return joined.select(
        "header",
        F.when(fits, block).otherwise(F.raise_error(F.lit("a record's block is missing or has another length")).cast("binary")).alias("block"),
        "payload",
    )


def field(header: Column, name: str) -> Column:
    """A named field's value; empty if the header lacks it."""
    return F.regexp_extract(header, rf"(?dm)^{name}: ([^\r\n]*)\r\n", 1)


def record_bytes(records: DataFrame) -> DataFrame:
    """Each record as the bytes of a WARC file: header, block, two line ends."""
    return records.select(F.concat("header", "block", F.lit((CRLF * 2).encode())).alias("record"))


def op2_rows(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, read it back, and report what the records say."""
    spark = pages.sparkSession
    path = path or archive_path(spark)
    write(pages, path)
    text = F.decode("header", "UTF-8")
    page = lambda name: F.regexp_extract(field(text, name), r"<urn:page:(-?\d+)>", 1)
    number = lambda name: F.when(page(name) != "", page(name)).cast("long")
    return read(spark, path).select(
        number("WARC-Record-ID").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field(text, "WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


#: op2 as SQL.
ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS body FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS first_id, payload_bytes >= 1000 AS big FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN big AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN big AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
