"""Stores that can be written again, looked up by row group, and counted while they are written."""

import shutil

from pyspark.sql import functions as F

from candisieve.sources import candidates as sc
from candisieve.sources import results as sr


def scanned(df):
    """Rows that the scan gave, from the metrics of the executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves, it = [], plan.collectLeaves().iterator()
    while it.hasNext():
        leaves.append(it.next())
    return sum(leaf.metrics().get("numOutputRows").get().value() for leaf in leaves if leaf.metrics().contains("numOutputRows"))


def test_lookup_skips_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    cand = spark.range(200_000).select(F.format_string("CAND_%07d", F.col("id") * 3).alias("candidate_id"),
                                       F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    sc.write_lookup_store(cand, path, row_group_bytes=256 << 10)
    ids = spark.createDataFrame([("CAND_0000300",), ("CAND_0450000",), ("CAND_0450000",), ("CAND_0000301",), (None,)], "candidate_id string")
    found = sc.stored_lookup(spark, path, ids)
    assert sorted(r.candidate_id for r in found.collect()) == ["CAND_0000300", "CAND_0450000"]
    assert scanned(found) < 40_000
    absent = sc.stored_lookup(spark, path, spark.createDataFrame([("CAND_0000302",), ("CAND_0450001",)], "candidate_id string"))
    assert absent.isEmpty() and scanned(absent) < 20_000
    many = cand.select("candidate_id").limit(700)
    assert sc.stored_lookup(spark, path, many).count() == 700
    assert sc.stored_lookup(spark, path, ids.where(F.lit(False))).isEmpty()


def test_results_written_again_replace_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/results"
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "job_id long, candidate_id string, rank long")

    def stored():
        return sorted((r.job_id, r.run, r.candidate_id) for r in sr.read_results(spark, path).collect())

    sr.write_results(rows, path, "v1")
    sr.write_results(rows.where("candidate_id <> 'b'"), path, "v1")
    assert stored() == [(1, "v1", "a"), (2, "v1", "c")]
    sr.write_results(rows.where("job_id = 1"), path, "v2")
    assert stored() == [(1, "v1", "a"), (1, "v2", "a"), (1, "v2", "b"), (2, "v1", "c")]
    # Without its mark, or with one of another number of rows, a run does not count.
    shutil.rmtree(tmp_path / "results" / "commits" / "job_id=2")
    sr._replace(rows.where("candidate_id = 'a'").withColumn("run", F.lit("v2")), f"{path}/rows")
    assert stored() == [(1, "v1", "a")]


def test_files_of_results_do_not_grow_with_jobs(spark, tmp_path):
    path, n = f"file://{tmp_path}/results", 300
    rows = spark.range(2 * n).select((F.col("id") % n).alias("job_id"), F.col("id").cast("string").alias("candidate_id"))
    sr.write_results(rows, path)
    assert len(list(tmp_path.rglob("*.parquet"))) < 100
    # A part of the jobs again, then all of them: what was replaced holds no rows.
    sr.write_results(rows.where("job_id % 64 = 3 and candidate_id < 300"), path)
    assert sr.read_results(spark, path).groupBy("job_id").count().groupBy("count").count().sort("count").collect() == [(1, 5), (2, n - 5)]
    sr.write_results(rows, path)
    assert sr.read_results(spark, path).count() == spark.read.parquet(f"{path}/rows").count() == 2 * n
    named = rows.select(F.concat(F.lit("j"), "job_id").alias("job_id"), "candidate_id")
    sr.write_results(named, f"{path}-named")
    assert sr.read_results(spark, f"{path}-named").count() == 2 * n
    # Nothing to store is no error, and leaves what is there.
    sr.write_results(rows.where("id < 0"), path)
    assert sr.read_results(spark, path).count() == 2 * n


def test_fingerprint_comes_from_the_listing(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    spark.range(1_000).write.parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "table").glob("part-*"))
    assert sr.dataset_fingerprint(spark, path).first().dataset_size == size


def test_ingest_counts_while_it_writes(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    lines = spark.createDataFrame([("not json",), ("  ",), ('{"candidate_id": "CAND_0000001"}',), ("[1]",)], "value string")
    counts = {r.verdict: r.n for r in sc.ingest(lines, path, {"required": ["candidate_id", "profile"]}).collect()}
    assert sum(counts.values()) == 3 and counts["good"] == 0
    held = {r.verdict: r["count"] for r in spark.read.parquet(path).groupBy("verdict").count().collect()}
    assert held == {k: n for k, n in counts.items() if n}
