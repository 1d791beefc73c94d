"""Incremental ingestion of candidate files.

New JSON-lines files are parsed and checked as they arrive. All checks are per row, so the
stream carries no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candisieve.sources.candidates import CANDIDATE_SCHEMA, parse_candidates, with_reject_reason


def stream_candidates(spark: SparkSession, path: str, signals_key: str = "signals", required: dict | None = None) -> DataFrame:
    """Parsed candidates with ``reject_reason``, as a stream over the files below ``path``."""
    return with_reject_reason(parse_candidates(spark.readStream.text(path), signals_key), required)


def ingest(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append valid candidates and quarantined lines to one table, partitioned by verdict;
    runs until all files present at the start are taken in."""
    rows = stream.select(*CANDIDATE_SCHEMA.fieldNames(), "value", "reject_reason", F.when(
        F.col("reject_reason").isNull(), "valid").otherwise("quarantined").alias("verdict"))
    return (rows.writeStream.format("parquet").partitionBy("verdict").option("path", store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
