"""Joins by shares: the rows of plain joins, and no task that meets all rows of one key."""

from pyspark.sql import functions as F

from candisieve.functions.topk import SHARE_ROWS, join_shares, key_shares, with_share
from candisieve.session import materialize
from candisieve.operators import scoring


def test_rows_of_a_plain_join(spark):
    rows = spark.createDataFrame(
        [(0, f"c{i}") for i in range(40)] + [(0, "c1"), (0, None), (1, "c1"), (2, "c2"), (None, "c3")], "job_id long, candidate_id string")
    other = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (3, "c"), (None, "d")], "job_id long, x string")
    shares = key_shares(rows, "job_id", 4)
    assert [tuple(r) for r in shares.collect()] == [(0, 11)]
    dealt = with_share(rows, shares, "job_id", "candidate_id")
    got = join_shares(dealt, other, shares, "job_id").select("job_id", "candidate_id", "x")
    want = rows.join(other, "job_id").select("job_id", "candidate_id", "x")
    key = lambda r: tuple(map(str, r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert dealt.where("job_id = 0").select("_share").distinct().count() > 5


def test_scored_rows_of_a_large_job_are_dealt_out(spark, monkeypatch):
    """The ladder of one job's rows runs in several tasks."""
    n = 8 * SHARE_ROWS
    cohort = spark.range(n).select(F.lit(7).cast("long").alias("job_id"), F.col("id").cast("string").alias("candidate_id"))
    jobs = spark.createDataFrame([(7, "t", ["Python"], ["Go"], ["Python"], 1.0)], """job_id long, title string, requirements array<string>,
        preferred_skills array<string>, technical_skills array<string>, min_years double""")
    cand = cohort.select("candidate_id", F.lit("python").alias("name"))
    found = {}

    def caught(rows, *_):
        found["rows"] = rows.select("job_id", "candidate_id", "name", "units")
        return rows
    monkeypatch.setattr(scoring, "score_rows", caught)
    monkeypatch.setattr(scoring, "build_profile", lambda c: c)
    monkeypatch.setattr(scoring, "with_confidence", lambda c, _: c)
    monkeypatch.setattr(scoring, "prepare_candidates", lambda c: c)
    # Written first: small rows would not be shuffled at all.
    rarity = spark.createDataFrame([], "job_id long, skill string, rarity double")
    for name, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(name, value)
    try:
        scoring.score_cohort(materialize(cohort, "cohort"), jobs, materialize(cand, "cand"), rarity=rarity)
        sizes = [r["count"] for r in found["rows"].groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == n and max(sizes) < n


def test_candidates_stay_where_their_id_is(spark, monkeypatch):
    """The wide rows of candidates are not shuffled by job: all pairs of a candidate lie together."""
    jobs = spark.createDataFrame([(j, "t", ["Python"], ["Go"], ["Python"], 1.0) for j in range(40)], """job_id long, title string,
        requirements array<string>, preferred_skills array<string>, technical_skills array<string>, min_years double""")
    cand = spark.range(20).select(F.col("id").cast("string").alias("candidate_id"), F.lit("python").alias("name"))
    cohort = jobs.select("job_id").crossJoin(cand.select("candidate_id"))
    found = {}
    monkeypatch.setattr(scoring, "score_rows", lambda rows, *_: found.setdefault("rows", rows.select("job_id", "candidate_id", "name", "units")))
    monkeypatch.setattr(scoring, "build_profile", lambda c: c)
    monkeypatch.setattr(scoring, "with_confidence", lambda c, _: c)
    monkeypatch.setattr(scoring, "prepare_candidates", lambda c: c)
    rarity = spark.createDataFrame([], "job_id long, skill string, rarity double")
    for name, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(name, value)
    try:
        scoring.score_cohort(materialize(cohort, "cohort"), jobs, materialize(cand, "cand"), rarity=rarity)
        at = found["rows"].select("candidate_id", F.spark_partition_id().alias("p")).groupBy("candidate_id").agg(
            F.count("*").alias("n"), F.count_distinct("p").alias("parts")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(at) == 20 and all((r["n"], r["parts"]) == (40, 1) for r in at)


def test_prepared_rows_are_not_broadcast(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("job_id"), F.col("id").cast("string").alias("candidate_id"))
    other = spark.range(3).select(F.col("id").alias("job_id"), F.lit("x").alias("x"))
    shares = key_shares(rows, "job_id")
    joined = join_shares(with_share(rows, shares, "job_id", "candidate_id"), other, shares, "job_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [job_id" in plan
    assert joined.count() == 100
