"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256 digest; the exact header bytes of every record
are stored apart and name that digest. Original records come back by joining both on the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candisieve.session import scratch_path

LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _uuid(*parts: Column) -> Column:
    """A record id that only depends on its page, in the form of a UUID."""
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, 21, 12))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid(F.lit("page"), page_id.cast("string")), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """One header line, or nothing if the value is null. Line breaks inside a value become blanks."""
    flat = F.regexp_replace(value.cast("string"), "[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), flat, F.lit(CRLF)), F.lit(""))


def read_field(head: Column, name: str) -> Column:
    """The value of a header field, null if the record has none."""
    return F.nullif(F.regexp_extract(head, f"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write ``page_id, url, html`` as ``{path}/payloads`` and ``{path}/records``.

    ``payloads``: ``digest, payload``, one row per distinct payload. ``records``: ``page_id, head,
    digest``; ``head`` holds the header bytes as a WARC file has them, with the empty line. Of equal
    payloads of at least ``least_bytes`` bytes the smallest page_id is the response and the others
    revisit it; shorter ones are all responses. Null html is an empty payload; a null url leaves the
    target line out; a null page_id counts as larger than any other and is written as an empty page
    line. Rows repeating both page_id and payload are one response and revisits of it.

    Grouping by digest and payload compares bytes, so a digest that two payloads shared would raise
    an error. Equal payloads collapse in each task before they are shuffled.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"))
    rows = rows.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    stored = rows.groupBy("digest", "payload").agg(F.min("page_id").alias("first_id")).select("digest", "payload", "first_id")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    spark = pages.sparkSession
    firsts = spark.read.parquet(f"{path}/payloads").select("digest", "first_id")
    twice = firsts.groupBy("digest").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("two payloads share a SHA-256 digest")
    slim = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("n_bytes"))
    again = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy(F.col("url").asc_nulls_last()))
    met = slim.withColumn("again", again).join(firsts, "digest")
    revisit = (F.col("n_bytes") >= least_bytes) & ~(F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("again") == 1))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Page-ID", F.col("page_id")),
        F.when(revisit, F.concat(
            field("WARC-Refers-To", record_id(F.col("first_id"))),
            field("WARC-Refers-To-Page-ID", F.col("first_id")),
            field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))),
        F.lit(CRLF))
    met.select("page_id", F.encode(head, "UTF-8").alias("head"), "digest").write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records with their payloads: ``page_id, head, payload, digest``.

    ``payload`` is the full payload, also of revisits, found by digest. Each stored payload is
    digested again on reading; one that does not fit its digest raises an error.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", F.when(
        F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.lit("payload does not fit its digest"))).alias("payload"))
    return spark.read.parquet(f"{path}/records").join(payloads, "digest").select("page_id", "head", "payload", "digest")


def original_record(head: Column, payload: Column) -> Column:
    """The bytes of the record as a WARC file holds them; a revisit has no block."""
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    block = F.when(read_field(F.decode(head, "UTF-8"), "WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(payload)
    return F.concat(head, block, end)


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """Per record, as read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes``."""
    read = read_archive(spark, path)
    head = F.decode("head", "UTF-8")
    return read.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        read_field(head, "WARC-Type").alias("record_type"),
        read_field(head, "WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.octet_length(original_record(F.col("head"), F.col("payload"))).cast("long").alias("record_bytes"))


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive (to a fresh shared folder unless ``path`` is given) and report what it holds."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    write_archive(pages, path)
    return archive_report(spark, path)
