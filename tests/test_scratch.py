"""Scratch tables free what they no longer need."""

import time

from pyspark.sql import functions as F

from candisieve import session
from candisieve.session import discard, materialize


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_freed(spark):
    held = shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = materialize(counts.join(counts.withColumnRenamed("count", "again"), "k"), "freed")
    until = time.time() + 10
    while shuffle_files(spark) - held and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - held
    assert kept.count() == 7 and counts.count() == 7


def test_a_discarded_table_is_gone_and_others_stay(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    first, second = materialize(spark.range(3), "first"), materialize(spark.range(4), "second")
    discard(first, None, spark.range(5))
    discard(first)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["second"] and second.count() == 4
