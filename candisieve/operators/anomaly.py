"""Implausible profiles: hard flags, soft penalties, duplicate demotion.

All rules but the last read one profile row (``build_profile``) and are plain column
expressions, so any number of them costs one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candisieve.functions.fixed_values import (
    AS_OF_DATE, AS_OF_YEAR, EXPERT_LEVELS, RELEASE_YEARS, SENIOR_TITLE_WORDS,
)
from candisieve.functions.text import (
    bounded_in, contains_any, in_words, lower_strip, mark_bounds, py_mark_literal, records, try_date,
)
from candisieve.functions.topk import top_k_per_key

YEARS = "years_of_experience"


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


# ---------------------------------------------------------------- hard flags

def flag_salary() -> Column:
    """Expected minimum above the maximum."""
    pay = F.col("signals.expected_salary_range_inr_lpa")
    return F.coalesce(pay["min"] > pay["max"], F.lit(False))


def flag_activity_dates() -> Column:
    """Last active before sign-up; unreadable dates are skipped."""
    return F.coalesce(
        try_date(F.col("signals.last_active_date")) < try_date(F.col("signals.signup_date")),
        F.lit(False))


def flag_job_dates(as_of_year: int = AS_OF_YEAR) -> Column:
    """A job that ends before it starts, or starts after the current year."""
    def wrong(job: Column) -> Column:
        start, end = try_date(job["start_date"]), try_date(job["end_date"])
        return F.coalesce(end < start, F.lit(False)) | F.coalesce(F.year(start) > as_of_year, F.lit(False))
    return F.exists("career_history", wrong)


def flag_job_length() -> Column:
    """A single job longer than all experience plus half a year."""
    return F.exists("career_history", lambda j: F.coalesce(
        j["duration_months"] / F.lit(12.0) > F.col(YEARS) + 0.5, F.lit(False)))


def is_flagged(as_of_year: int = AS_OF_YEAR) -> Column:
    """A01-A04 together."""
    return flag_salary() | flag_activity_dates() | flag_job_dates(as_of_year) | flag_job_length()


# ---------------------------------------------------------------- soft penalties

def has_overlap(as_of: str = AS_OF_DATE, max_days: int = 90) -> Column:
    """Two jobs next to each other in start order, at different companies, that
    overlap by more than ``max_days``. An open job ends at ``as_of``."""
    def dated(job: Column, pos: Column) -> Column:
        end = F.when(_given(job["end_date"]), try_date(job["end_date"])).otherwise(
            F.to_date(F.lit(as_of)))
        return F.struct(try_date(job["start_date"]).alias("start"), pos.alias("pos"),
                        end.alias("end"), job["company"].alias("company"))
    jobs = F.array_sort(F.filter(
        F.transform("career_history", dated), lambda j: j["start"].isNotNull() & j["end"].isNotNull()))
    rest = F.greatest(F.size(jobs) - 1, F.lit(0))

    def clash(a: Column, b: Column) -> Column:
        return (a["company"] != b["company"]) & (F.datediff(a["end"], b["start"]) > max_days)
    return F.exists(
        F.zip_with(F.slice(jobs, F.lit(1), rest), F.slice(jobs, F.lit(2), rest), clash), lambda x: x)


def senior_titles() -> Column:
    """Titles claiming seniority, in job order."""
    titles = F.transform("career_history", lambda j: j["title"])
    return F.filter(titles, lambda t: contains_any(F.lower(t), SENIOR_TITLE_WORDS))


def has_promotion_anomaly() -> Column:
    """A senior title within the first year and a half."""
    return (F.col(YEARS) < 1.5) & (F.size(senior_titles()) > 0)


def total_job_years() -> Column:
    months = F.aggregate("career_history", F.lit(0).cast("long"),
                         lambda acc, j: acc + F.coalesce(j["duration_months"], F.lit(0)))
    return months / F.lit(12.0)


def has_tenure_anomaly() -> Column:
    """Job durations add up to more than experience plus five years."""
    return total_job_years() > F.col(YEARS) + 5.0


def has_education_anomaly() -> Column:
    """A degree ends before it starts, or school ends after college."""
    dated = F.filter("education", lambda e: (F.coalesce(e["start_year"], F.lit(0)) != 0)
                     & (F.coalesce(e["end_year"], F.lit(0)) != 0))
    backwards = F.exists(dated, lambda e: e["end_year"] < e["start_year"])
    is_school = lambda d: contains_any(d, ["high school", "hsc", "matric"])
    is_college = lambda d: contains_any(d, ["bachelor", "b.s", "b.e", "b.tech", "college"])

    def row(e: Column, pos: Column) -> Column:
        return F.struct(e["start_year"].alias("s"), pos.alias("pos"), e["end_year"].alias("e"),
                        F.lower(e["degree"]).alias("d"))
    ordered = F.array_sort(F.transform(dated, row))
    school = F.filter(ordered, lambda x: is_school(x["d"]))
    college = F.filter(ordered, lambda x: ~is_school(x["d"]) & is_college(x["d"]))
    late_school = F.try_element_at(school, F.lit(-1))["e"] > F.try_element_at(college, F.lit(-1))["e"]
    return backwards | F.coalesce(late_school, F.lit(False))


def expert_count() -> Column:
    return F.size(F.filter("skills", lambda s: in_words(F.lower(s["proficiency"]), EXPERT_LEVELS)))


def has_expert_anomaly(limit: int = 15) -> Column:
    """A09."""
    return expert_count() > limit


def has_endorsement_anomaly() -> Column:
    """A10: many endorsements with little experience or few connections."""
    return (F.col("signals.endorsements_received") > 300) & (
        (F.col(YEARS) < 1.5) | (F.col("signals.connection_count") < 15))


def has_release_anomaly(
    releases: Mapping[str, int] = RELEASE_YEARS, as_of_year: int = AS_OF_YEAR,
) -> Column:
    """A technology used for longer than it exists."""
    known = records({"mark": py_mark_literal(name), "allowed": as_of_year - year + 0.5}
                    for name, year in releases.items())
    shortest = as_of_year - max(releases.values()) + 0.5
    claimed = F.filter(
        F.transform("skills", lambda s: F.struct(
            s["name"].alias("name"),
            (F.coalesce(s["duration_months"], F.lit(0)) / F.lit(12.0)).alias("years"))),
        lambda s: s["years"] > shortest)
    marked = F.transform(claimed, lambda s: F.struct(
        mark_bounds(lower_strip(s["name"])).alias("mark"), s["years"].alias("years")))
    return F.exists(marked, lambda s: F.exists(
        known, lambda t: (s["years"] > t["allowed"]) & bounded_in(t["mark"], s["mark"])))


def has_phd_anomaly() -> Column:
    """A doctorate in headline or summary, but none among the degrees."""
    claimed = contains_any(F.lower("headline"), ["phd", "ph.d"]) | contains_any(
        F.lower("summary"), ["phd", "ph.d"])
    held = F.exists("education", lambda e: contains_any(F.lower(e["degree"]), ["phd", "ph.d", "doctor"]))
    return claimed & ~held


def penalties(as_of: str = AS_OF_DATE, as_of_year: int = AS_OF_YEAR) -> list[tuple[Column, float, Column]]:
    """The rules behind A13: condition, points, reason."""
    return [
        (has_overlap(as_of), 15.0,
         F.lit("Chronological Overlaps: concurrent full-time jobs overlapping by > 3 months")),
        (has_promotion_anomaly(), 20.0, F.format_string(
            "Promotion Anomaly: role '%s' with < 1.5 years of total experience",
            F.get(senior_titles(), F.lit(0)))),
        (has_tenure_anomaly(), 20.0, F.format_string(
            "Job duration sum (%.1f years) significantly exceeds total experience (%s years)",
            F.bround(total_job_years(), 1), F.col(YEARS).cast("string"))),
        (has_education_anomaly(), 20.0, F.lit(
            "Education Timeline Anomaly: inconsistent high school / college graduation dates")),
        (has_expert_anomaly(), 15.0, F.format_string(
            "Unrealistic Skill Claims: expert/advanced proficiency in %d distinct technologies",
            expert_count())),
        (has_endorsement_anomaly(), 15.0, F.format_string(
            "Suspicious Endorsement Inflation: %d endorsements with low experience/connections",
            F.col("signals.endorsements_received"))),
        (has_release_anomaly(as_of_year=as_of_year), 30.0, F.lit(
            "Technology Release Anomaly: technology usage duration exceeds release history")),
        (has_phd_anomaly(), 15.0, F.lit(
            "Contradictory Profile Information: PhD claimed in summary/headline but not listed in education")),
    ]


def with_confidence(profile: DataFrame, as_of: str = AS_OF_DATE) -> DataFrame:
    """Add ``confidence_score``, ``confidence_penalties`` and ``is_honeypot``.

    ``is_honeypot`` is a hard flag (A01-A04) or a confidence below 40.
    """
    year = int(as_of[:4])
    hits = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(points).alias("points"), reason.alias("reason")))
        for cond, points, reason in penalties(as_of, year)])
    return (
        profile
        .withColumn("_hits", F.filter(hits, lambda h: h.isNotNull()))
        .withColumn("confidence_score", F.greatest(F.lit(0.0), F.lit(100.0) - F.aggregate(
            "_hits", F.lit(0.0), lambda acc, h: acc + h["points"])))
        .withColumn("confidence_penalties", F.transform("_hits", lambda h: h["reason"]))
        .withColumn("hard_flag", is_flagged(year))
        .withColumn("is_honeypot", F.col("hard_flag") | (F.col("confidence_score") < 40.0))
        .drop("_hits")
    )


# ---------------------------------------------------------------- duplicates

def rank_order() -> list[Column]:
    """Final score, then behaviour, then id."""
    return [F.desc("final_score"), F.desc("behavior_score"), F.asc("candidate_id")]


DUPLICATE_FACTOR = 0.1


def same_person():
    """Rows of a job with equal name, years and title, by ``_rank``."""
    return Window.partitionBy(
        "job_id", lower_strip(F.col("name")), "years_of_experience", lower_strip(F.col("current_title"))).orderBy("_rank")


def demote_duplicates(scored: DataFrame, top: int = 100, factor: float = DUPLICATE_FACTOR) -> DataFrame:
    """Among the first ``top`` rows of each job, all but the best of equal (name,
    years, title) get ``factor`` of their score. One pass: rows that move up are not
    checked again. Adds ``is_duplicate``; row count is unchanged.

    Only the at most ``top`` rows per job are compared; the marks join back by key.
    """
    head = top_k_per_key(
        scored.select("job_id", "candidate_id", "final_score", "behavior_score", "name",
                      "years_of_experience", "current_title"),
        ["job_id"], rank_order(), top, ["candidate_id"], rank_col="_rank")
    marks = (
        head.withColumn("_nth", F.row_number().over(same_person())).filter("_nth > 1")
        .select("job_id", "candidate_id", F.lit(True).alias("is_duplicate"))
    )
    return (
        scored.join(marks, ["job_id", "candidate_id"], "left")
        .withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
        .withColumn("final_score", F.when(
            F.col("is_duplicate"), F.round(F.col("final_score") * factor, 4)
        ).otherwise(F.col("final_score")))
    )

