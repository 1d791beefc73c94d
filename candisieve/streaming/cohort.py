"""Cohort rarity kept up to date while applications arrive.

The numbers of mentions are the state of the stream. Each batch hands on the new totals of the jobs
and skills it changed, and only those; nothing that was counted is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candisieve.operators.skills import rarity_of, skill_mentions

TOTALS = "job_id long, skill string, n long"


def keep_counts(cohort: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Count a stream of ``job_id, skills`` into ``store`` until all files present at the start are taken in.

    A batch has a folder of its own, so one that is repeated after a failure replaces what it wrote.
    """
    counted = skill_mentions(cohort).groupBy("job_id", "skill").agg(F.count("*").alias("n"))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{store}/batch={batch}")
    return (counted.writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def kept_counts(spark: SparkSession, store: str) -> DataFrame:
    """``job_id, skill, n``: the last total of each, which is the largest, as mentions are only added."""
    return spark.read.schema(TOTALS).parquet(store).groupBy("job_id", "skill").agg(F.max("n").alias("n"))


def kept_rarity(spark: SparkSession, store: str) -> DataFrame:
    """``job_id, skill, rarity`` of all applications counted so far."""
    return rarity_of(kept_counts(spark, store))
