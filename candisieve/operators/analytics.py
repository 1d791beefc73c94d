"""Cohort analytics over stored results.

Every aggregate is one partially aggregated group-by per job; the top-k cuts come after
it, over the distinct names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.text import strip
from candisieve.functions.topk import top_k_per_key
from candisieve.operators.scoring import BREAKDOWN

UNKNOWN = ["unknown", "not specified"]


def _known(c: Column, unknown: Sequence[str] = UNKNOWN) -> Column:
    return (c != "") & ~F.lower(c).isin(*unknown)


def _counts(rows: DataFrame, name: str = "name") -> DataFrame:
    return rows.groupBy("job_id", name).agg(F.count("*").alias("count"))


def _top(counts: DataFrame, k: int) -> DataFrame:
    return top_k_per_key(counts, ["job_id"], [F.desc("count"), F.asc("name")], k, ["name"])


def _each(results: DataFrame, array: str) -> DataFrame:
    return results.select("job_id", F.explode(array).alias("name"))


def top_missing(results: DataFrame, k: int = 5) -> DataFrame:
    """N01."""
    return _top(_counts(_each(results, "missing_skills")), k)


def _with_profile(results: DataFrame, cand: DataFrame, *columns) -> DataFrame:
    return results.select("job_id", "candidate_id").join(cand.select("candidate_id", *columns), "candidate_id")


def top_universities(results: DataFrame, cand: DataFrame, k: int = 5) -> DataFrame:
    """N02."""
    rows = _with_profile(results, cand, "education").select("job_id", F.explode("education").alias("e"))
    names = rows.select("job_id", strip(F.coalesce("e.institution", F.lit(""))).alias("name"))
    return _top(_counts(names.filter(_known(F.col("name")))), k)


def top_locations(results: DataFrame, profile: DataFrame, k: int = 5) -> DataFrame:
    """N03."""
    names = _with_profile(results, profile, "location").select("job_id", strip("location").alias("name"))
    return _top(_counts(names.filter(_known(F.col("name")))), k)


def work_modes(results: DataFrame, cand: DataFrame) -> DataFrame:
    """First letter upper case, the rest lower."""
    mode = strip("mode")
    names = _with_profile(results, cand, F.col("signals.preferred_work_mode").alias("mode")).select(
        "job_id", mode.alias("mode")).filter(_known(F.col("mode")))
    return _counts(names.select("job_id", F.concat(
        F.upper(F.substr("mode", F.lit(1), F.lit(1))), F.lower(F.substr("mode", F.lit(2)))).alias("range")), "range")


def education_tiers(results: DataFrame, cand: DataFrame) -> DataFrame:
    """N05."""
    rows = _with_profile(results, cand, "education").select("job_id", F.explode("education").alias("e"))
    return _counts(rows.filter("e.tier IS NOT NULL").select(
        "job_id", F.concat(F.lit("Tier "), F.col("e.tier")).alias("range")), "range")


def pipeline_health(index: DataFrame, metrics: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Index size and dimension beside the run's cohort size and flagged share."""
    honeypots = F.col("honeypots_detected_in_cohort")
    size = F.col("cohort_size")
    facts = index.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("dim"))
    return metrics.select(
        "*", facts.select("n").scalar().alias("candidate_count"),
        F.coalesce(facts.select("dim").scalar(), F.lit(0)).cast("long").alias("embedding_dimension"),
        F.when(size > 0, honeypots / size).otherwise(0.0).alias("honeypot_rate"))


def _histogram(rows: DataFrame, value: Column, bounds: Sequence[tuple[str, float | None]]) -> DataFrame:
    """Counts per bucket, each up to and including its bound; empty buckets show 0.

    Buckets are counted as conditional sums, so a job's row count never matters.
    """
    counts, below = [], F.lit(False)
    for i, (name, bound) in enumerate(bounds):
        within = F.lit(True) if bound is None else value <= bound
        counts.append(F.count_if(within & ~below).alias(f"b{i}"))
        below = below | within
    wide = rows.groupBy("job_id").agg(*counts)
    entries = F.array(*[
        F.struct(F.lit(name).alias("range"), F.col(f"b{i}").alias("count")) for i, (name, _) in enumerate(bounds)])
    return wide.select("job_id", F.inline(entries))


def score_histogram(results: DataFrame) -> DataFrame:
    """N07."""
    return _histogram(results, F.col("final_score"), [
        ("0-30 pts", 30), ("31-60 pts", 60), ("61-90 pts", 90), ("91-120 pts", 120), ("121-150 pts", None)])


def experience_histogram(results: DataFrame) -> DataFrame:
    """N08."""
    years = F.col("years_of_experience")
    return _histogram(results.filter(years.isNotNull()), years, [
        ("0-2 yrs", 2), ("3-5 yrs", 5), ("6-9 yrs", 9), ("10+ yrs", None)])


def notice_histogram(results: DataFrame) -> DataFrame:
    """N09."""
    days = F.col("notice_period_days")
    return _histogram(results.filter(days.isNotNull()), days, [
        ("Immediate", 0), ("1-30 days", 30), ("31-60 days", 60), ("60+ days", None)])


def top_skills(results: DataFrame, k: int = 5) -> DataFrame:
    """N10."""
    names = _each(results, "skills").select("job_id", strip("name").alias("name"))
    return _top(_counts(names.filter(_known(F.col("name")))), k)


def top_companies(results: DataFrame, k: int = 5) -> DataFrame:
    """N11."""
    names = results.select("job_id", strip(F.coalesce("current_company", F.lit(""))).alias("name"))
    return _top(_counts(names.filter(_known(F.col("name"), [*UNKNOWN, "none"]))), k)


def risk_distribution(results: DataFrame) -> DataFrame:
    """N12."""
    flagged = F.coalesce("is_honeypot", F.lit(False))
    wide = results.groupBy("job_id").agg(
        F.count_if(~flagged).alias("clear"), F.count_if(flagged).alias("flagged"))
    return wide.select("job_id", F.inline(F.array(
        F.struct(F.lit("Verified Clear").alias("range"), F.col("clear").alias("count")),
        F.struct(F.lit("Flagged Risk").alias("range"), F.col("flagged").alias("count")))))


def avg_subscores(results: DataFrame) -> DataFrame:
    """N13."""
    return results.groupBy("job_id").agg(*[
        F.avg(F.coalesce(p, F.lit(0.0))).alias(p.removesuffix("_score")) for p in BREAKDOWN])


def kpis(results: DataFrame) -> DataFrame:
    """N14."""
    flagged = F.coalesce("is_honeypot", F.lit(False))
    share = F.count_if("open_to_work") / F.count("*") * 100
    return results.groupBy("job_id").agg(
        F.count("*").alias("total"), F.max("final_score").alias("highest_score"),
        F.avg("final_score").alias("average_score"), F.floor(share + 0.5).alias("open_to_work_pct"),
        F.count_if(flagged).alias("flagged"), F.count_if(~flagged).alias("verified"))

