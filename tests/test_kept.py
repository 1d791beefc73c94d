"""Counts that a stream keeps, and pages of a stored order."""

from pyspark.sql import functions as F

from candisieve.operators import explore as xp
from candisieve.operators.skills import skill_rarity
from candisieve.streaming.cohort import keep_counts, kept_counts, kept_rarity

COHORT = "job_id long, skills array<struct<name:string>>"


def rows(df):
    return sorted((r.job_id, r.skill, round(r.rarity, 9)) for r in df.collect())


def test_rarity_after_several_batches(spark, tmp_path):
    first = [(1, [("Go",), ("SQL ",)]), (1, [("go",), ("go",)]), (2, []), (2, None), (3, [("Rust",)])]
    later = [(1, [("sql",)]), (2, [("Go",)]), (4, [("go",)])]
    inbox, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))

    def arrive(some):
        for k, row in enumerate(some):
            spark.createDataFrame([row], COHORT).coalesce(1).write.mode("append").parquet(inbox)

    def take():
        stream = spark.readStream.schema(COHORT).option("maxFilesPerTrigger", 2).parquet(inbox)
        keep_counts(stream, store, state).awaitTermination()
    seen = []
    for some in (first, later):
        arrive(some)
        seen += some
        take()
        assert rows(kept_rarity(spark, store)) == rows(skill_rarity(spark.createDataFrame(seen, COHORT)))
    batches = sorted(p.name for p in (tmp_path / "store").iterdir() if p.name.startswith("batch="))
    assert len(batches) >= 5
    # A batch holds the totals it changed, not the whole state.
    last = spark.read.parquet(f"{store}/{batches[-1]}")
    assert 0 < last.count() < kept_counts(spark, store).count()


def test_a_page_reads_the_ranges_that_hold_it(spark, tmp_path):
    results = spark.range(1_000).select(
        (F.col("id") % 3).alias("job_id"), F.format_string("C%04d", "id").alias("candidate_id"), F.col("id").alias("rank"),
        F.when(F.col("id") % 50 > 0, F.col("id") * 7 % 11 / 10.0).alias("final_score"))
    path = str(tmp_path / "pages")
    xp.write_pages(results, path, "score", "desc", parts=12)
    for number, size in ((1, 10), (7, 25), (40, 25), (2, 700), (41, 25), (500, 10)):
        want = xp.page(results, number, size, "score", "desc").collect()
        assert xp.stored_page(spark, path, number, size, "score", "desc").collect() == want
    assert 1 <= xp.parts_of_page(spark, path, 7, 25).count() <= 2 and xp.parts_of_page(spark, path, 500).isEmpty()
    none = str(tmp_path / "none")
    xp.write_pages(results.limit(0), none)
    assert xp.stored_page(spark, none, 1).isEmpty()
