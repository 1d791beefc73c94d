"""Job postings as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ["txt", "md"]


def accept_postings(documents: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Add ``accepted``: only plain text and Markdown names are read."""
    suffix = F.lower(F.regexp_extract(name_col, r"\.([^.\/]+)$", 1))
    return documents.withColumn("accepted", suffix.isin(*SUFFIXES))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, raw_text`` of every accepted file; the file name is the id."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw_text"))
    return accept_postings(files).filter("accepted").select(F.col("file_name").alias("job_id"), "raw_text")
