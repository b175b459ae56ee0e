"""A content-addressed WARC archive.

Two Parquet tables make an archive: ``payloads`` holds the bytes of every
distinct payload once, under its SHA-256; ``records`` holds the exact WARC and
HTTP header bytes of every record and the digest of its payload. Joining the
two on the digest gives back the original records byte for byte.

Rows of a hot payload stay narrow (id, url, digest) wherever rows meet by
digest, so only its single stored copy is wide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import shared_folder, stored, table
from graftwork.llm.registry import query

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
URN = "urn:page:"

MIN_REVISIT_BYTES = 100


def _lines(*parts: Column) -> Column:
    """Header lines; a null part leaves its line out."""
    return F.concat(F.array_join(F.array(*parts), EOL), F.lit(EOL + EOL))


def _record_uri(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{URN}"), page_id.cast("string"), F.lit(">"))


def with_revisits(df: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Per row of ``page_id, url, html``: digest, size, record type and what it refers to.

    Null html is the empty payload. Of equal payloads of at least ``min_bytes``
    the smallest page_id is the response. A repeated page_id gives a record per row.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = stored(
        df.select("page_id", "url", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n")),
        "rows",
    )
    first = stored(rows.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first")
    shared = (F.col("n") >= min_bytes) & (F.col("page_id") != F.col("first_id"))
    return rows.join(first, "digest").select(
        "page_id",
        "url",
        "digest",
        F.col("n").alias("payload_bytes"),
        F.when(shared, "revisit").otherwise("response").alias("record_type"),
        F.when(shared, F.col("first_id")).alias("refers_to"),
    )


def headers(df: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Exact WARC and HTTP header bytes of the rows of :func:`with_revisits`.

    Line breaks inside a url are percent-encoded; a null url has no target line.
    """
    http = _lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")),
    )
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    body = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    warc = _lines(
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_uri(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_uri(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), body.cast("string")),
    )
    return df.select("digest", warc.cast("binary").alias("warc_header"), http.cast("binary").alias("http_header"))


def write_archive(df: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``page_id, url, html`` as an archive; other columns are ignored.

    Payloads are grouped by digest and bytes, so two payloads under one digest
    would both be stored, and the write fails on them.
    """
    headers(with_revisits(df, min_bytes)).write.option("compression", "zstd").parquet(f"{path}/records")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    distinct = df.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).dropDuplicates(
        ["digest", "payload"]
    )
    distinct.write.option("compression", "zstd").parquet(f"{path}/payloads")
    stored_once = df.sparkSession.read.parquet(f"{path}/payloads").select("digest")
    twice = stored_once.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two payloads share the digest {twice[0]['digest']}")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.decode("warc_header", "utf-8"), rf"(?md)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def _id_in(uri: Column) -> Column:
    return F.regexp_extract(uri, rf"^<{URN}(-?\d+)>$", 1).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its payload, fields parsed from the stored header bytes.

    ``intact`` says that the payload has the digest and size that the headers state.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "digest",
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    records = spark.read.parquet(f"{path}/records")
    stated = F.regexp_extract(F.decode("http_header", "utf-8"), r"(?md)^Content-Length: (\d+)\r$", 1).cast("long")
    return (
        records.join(payloads, "digest", "left")
        .select(
            _id_in(_field("WARC-Record-ID")).alias("page_id"),
            _field("WARC-Target-URI").alias("url"),
            "payload_bytes",
            "payload_digest",
            _field("WARC-Type").alias("record_type"),
            _id_in(_field("WARC-Refers-To")).alias("refers_to"),
            (
                F.concat(F.lit("sha256:"), F.col("payload_digest")).eqNullSafe(_field("WARC-Payload-Digest"))
                & F.col("payload_bytes").eqNullSafe(stated)
            ).alias("intact"),
            "warc_header",
            "http_header",
            "payload",
        )
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """``page_id, record``: the whole WARC record of each row of :func:`read_archive`."""
    end = F.lit(EOL + EOL).cast("binary")
    payload = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("warc_header", "http_header", payload, end).alias("record"))


def export_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Plain WARC files; Spark's line separator is the end of a record."""
    whole = record_bytes(records).select(F.decode(F.expr("substring(record, 1, octet_length(record) - 4)"), "utf-8"))
    whole.write.option("lineSep", EOL + EOL).option("compression", compression).text(path)


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query("op2_warc_archive", sql=OP2_SQL)
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/graftwork-archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    fine = F.when(F.col("intact"), F.col("page_id")).otherwise(
        F.raise_error(F.lit("a record does not match its payload")).cast("long")
    )
    return records.select(
        fine.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
