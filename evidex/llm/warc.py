"""WARC archive with content-addressed payloads.

An archive is a folder with two Parquet tables: blobs (digest, payload: every payload once, under its
SHA-256) and headers (page_id, digest, header: the exact header block of each record). A reader joins
them, checks every payload against its digest and so gets the original records back.

Edge cases: null html is an empty payload; null url leaves out WARC-Target-URI, line breaks in a url
are percent-encoded; payloads of less than min_revisit bytes are always response; repeated rows are
separate records; a null page_id is written as an empty id, never refers and is read back as null;
an empty table gives an empty archive; further columns of pages are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, table

EOL = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _payload() -> F.Column:
    return F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))


def _id(col) -> F.Column:
    h = F.md5(F.concat(F.lit("page:"), col))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_revisit: int = 100) -> None:
    """Write pages (page_id, url, html) as an archive under path.

    Only (digest, page_id) pairs are aggregated, with partial aggregation, so a payload shared by a third
    of all pages costs a row per task; payload bytes are shuffled at most once, by digest and id together,
    which spreads copies of one payload, and only those of the record that keeps it are written.
    """
    rec = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload().alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.length("payload").cast("long"))
    first = rec.groupBy("digest").agg(F.min("page_id").alias("keeper"))
    f = first.withColumnRenamed("digest", "f_digest")
    # payload bytes once: the row of the keeper, one if it is repeated. Join and grouping have the same plain keys (no null), so they share one exchange
    key = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    kept = rec.select("digest", key("page_id").alias("key"), "payload").join(first.select("digest", key("keeper").alias("key")), ["digest", "key"], "left_semi")
    kept.groupBy("digest", "key").agg(F.first("payload").alias("payload")).select("digest", "payload").write.mode("overwrite").parquet(f"{path}/blobs")
    h = rec.drop("payload").join(f, F.col("digest") == F.col("f_digest"))
    revisit = (F.col("n") >= min_revisit) & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("keeper"))
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id(pid)),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id(F.col("keeper").cast("string")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("X-Page-ID: "), pid),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("keeper").cast("string"))),
        F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
    ]
    h.select("page_id", "digest", F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL)).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, with_record: bool = True) -> DataFrame:
    """Records of the archive: what the header says, the payload's own length and digest (taken from the bytes read), and with_record the exact record bytes.

    A payload that doesn't match its digest fails the read.
    """
    own = F.sha2("payload", 256)
    blobs = spark.read.parquet(f"{path}/blobs").select(
        F.col("digest").alias("b_digest"), "payload", F.length("payload").cast("long").alias("payload_bytes"),
        F.when(own == F.col("digest"), own).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match "), F.col("digest")))).alias("payload_digest"))
    heads = spark.read.parquet(f"{path}/headers").select("digest", "header")
    field = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    rec = heads.join(blobs, F.col("digest") == F.col("b_digest")).select(
        F.when(field("X-Page-ID") != "", field("X-Page-ID").cast("long")).alias("page_id"),
        F.when(F.col("header").contains(f"{EOL}WARC-Target-URI: "), field("WARC-Target-URI")).alias("url"), "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"), F.when(field("X-Refers-To-Page-ID") != "", field("X-Refers-To-Page-ID").cast("long")).alias("refers_to"),
        "header", "payload")
    if not with_record:
        return rec.drop("header", "payload")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return rec.withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit(EOL + EOL).cast("binary")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is rebuilt through the join; record_sha256 is of its bytes."""
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def _urn(x: str) -> str:
    h = f"md5('page:' || {x})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


OP9_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, b, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS k FROM d),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> k AS again FROM m),
h AS (SELECT *, array_to_string(list_filter(['WARC/1.1', 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END, 'WARC-Record-ID: ' || {_urn("page_id")}, 'WARC-Date: {DATE}',
  'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), 'WARC-Payload-Digest: sha256:' || payload_digest, CASE WHEN again THEN 'WARC-Refers-To: ' || {_urn("k")} END,
  CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' END, 'X-Page-ID: ' || page_id, CASE WHEN again THEN 'X-Refers-To-Page-ID: ' || k END,
  'X-Payload-Length: ' || payload_bytes, 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END], lambda x: x IS NOT NULL), chr(13) || chr(10)) AS head FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN k END AS refers_to,
  sha256(encode(head || chr(13) || chr(10) || chr(13) || chr(10)) || CASE WHEN again THEN ''::BLOB ELSE b END || encode(chr(13) || chr(10) || chr(13) || chr(10))) AS record_sha256 FROM h
"""
