"""Explanations of scored rows (E01-E10). Projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.text import bounded_in, let, mark_bounds, mark_literal, no_strings, strip

YEARS = "years_of_experience"


def _clean(names: Column) -> Column:
    """Names without their "(via ...)" note."""
    return F.transform(names, lambda s: strip(F.get(F.split(s, r" \(via"), F.lit(0))))


def _list(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, no_strings())


def _first_by_lower(names: Column) -> Column:
    return let(F.transform(names, F.lower), lambda low: F.filter(
        names, lambda s, i: F.array_position(low, F.lower(s)) == i + 1))


def matched_names() -> Column:
    tiers = F.concat(_list("critical_skills_matched"), _list("important_skills_matched"),
                     _list("nice_to_have_skills_matched"))
    return _first_by_lower(_clean(tiers))


def overview() -> Column:
    """E01."""
    name = F.coalesce(F.nullif(strip("name"), F.lit("")), F.concat(F.lit("Candidate "), F.col("candidate_id")))
    title, company = F.coalesce(strip("current_title"), F.lit("")), F.coalesce(strip("current_company"), F.lit(""))
    years = F.col(YEARS)
    return (
        F.when((title != "") & (company != ""), F.format_string(
            "%s is currently a %s at %s with %.1f years of relevant experience.", name, title, company, years))
        .when(title != "", F.format_string(
            "%s brings %.1f years of professional experience, working as a %s.", name, years, title))
        .otherwise(F.format_string("%s has %.1f years of technical experience in this domain.", name, years)))


def strengths() -> Column:
    """The first five distinct matched requirements."""
    return let(matched_names(), lambda names: F.when(
        F.size(names) > 0, F.concat(F.lit("Strengths: Direct evidence verified for "),
                                    F.array_join(F.slice(names, 1, 5), ", "), F.lit(".")))
        .otherwise("Strengths: General domain background with limited direct skill overlap."))


def gap_names() -> Column:
    """Missing critical requirements, then requirements and preferences that no matched
    name equals. A critical gap is dropped only if its lower-case form is already listed
    as such; later ones only if listed verbatim."""
    def add_gap(acc: Column, gap: Column) -> Column:
        return F.when(F.array_contains(acc, F.lower(gap)), acc).otherwise(F.concat(acc, F.array(gap)))
    critical = F.aggregate(_clean(_list("missing_critical_skills")), no_strings(), add_gap)
    wanted = F.concat(
        F.transform(_list("requirements"), strip),
        F.transform(F.filter(_list("preferred_skills"), lambda p: F.lower(p) != "none specified"), strip))
    known = F.transform(matched_names(), F.lower)

    def add_wanted(acc: Column, line: Column, known: Column) -> Column:
        skip = F.array_contains(known, F.lower(line)) | F.array_contains(acc, line)
        return F.when(skip, acc).otherwise(F.concat(acc, F.array(line)))
    return let(known, lambda k: F.aggregate(wanted, critical, lambda acc, line: add_wanted(acc, line, k)))


def gaps() -> Column:
    """The first four gaps."""
    return let(gap_names(), lambda names: F.when(
        F.size(names) > 0, F.concat(F.lit("Gaps: Lacks documented skill evidence for "),
                                    F.array_join(F.slice(names, 1, 4), ", "), F.lit(".")))
        .otherwise("Gaps: Complete skill requirement coverage confirmed."))


def _flagged() -> Column:
    return F.coalesce("is_honeypot", F.lit(False))


def risks() -> Column:
    """E04."""
    days = F.col("notice_period_days")
    concerns = F.concat_ws(
        ", ", F.when(_flagged(), "flagged for career timeline discrepancies"),
        F.when(days > 60, F.concat(days.cast("string"), F.lit("-day notice period requirement"))))
    return F.when(concerns != "", F.concat(F.lit("Risks: "), concerns, F.lit("."))).otherwise(
        "Risks: No timeline anomalies or availability flags.")


def recommendation() -> Column:
    """E05."""
    score = F.coalesce("final_score", F.lit(0.0))
    return (
        F.when(score >= 80, F.concat(
            F.lit("Recommendation: Strong candidate for the "), F.col("job_title"),
            F.lit(" position based on core requirement coverage.")))
        .when(score >= 60, "Recommendation: Recommended for preliminary interview to verify specific skill depth.")
        .otherwise("Recommendation: Lower priority review due to key skill gaps against job requirements."))


def reasoning() -> Column:
    return F.concat_ws(" ", overview(), strengths(), gaps(), risks(), recommendation())


def with_reasoning(scored: DataFrame) -> DataFrame:
    return scored.withColumn("reasoning", reasoning())


def explain(pairs: DataFrame, profile: DataFrame, jobs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Explanations of the profiles in ``pairs``; a profile without evaluation is
    explained as one without any evidence and score 0."""
    job = jobs.select("job_id", F.col("title").alias("job_title"), "requirements", "preferred_skills")
    facts = evaluations.select(
        "job_id", "candidate_id", "is_honeypot", "final_score", "critical_skills_matched",
        "important_skills_matched", "nice_to_have_skills_matched", "missing_critical_skills")
    rows = (
        pairs.select("job_id", "candidate_id")
        .join(profile.select("candidate_id", "name", "current_title", "current_company", YEARS, "notice_period_days"),
              "candidate_id")
        .join(job, "job_id").join(facts, ["job_id", "candidate_id"], "left"))
    return rows.select("job_id", "candidate_id", reasoning().alias("reasoning"))


# ------------------------------------------------------------------ short forms

def advice_action() -> Column:
    """E07."""
    score = F.col("final_score")
    return (F.when(_flagged(), "Do Not Interview")
            .when(score >= 80, "Strong Candidate - Highly Recommended")
            .when(score >= 60, "Recommended for Preliminary Screening").otherwise("Review Qualifications"))


def advice_text() -> Column:
    score = F.col("final_score")
    return (
        F.when(_flagged(), "Profile flagged with critical chronological discrepancies in career history. "
               "Security verification failed.")
        .when(score >= 80, "Solid technical alignment against job requirements. Strong background and verified "
              "candidate signals.")
        .when(score >= 60, "Good general compatibility. Recommended for initial recruiter screening.")
        .otherwise("Key requirements unverified or missing. Review candidate credentials manually."))


def badges() -> Column:
    """E08."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    years = F.coalesce(YEARS, F.lit(0.0))
    rules = F.array(
        F.when((zero("skill_score") >= 20) | (F.col("final_score") >= 60), "Strong Skill Match"),
        F.when((zero("experience_score") >= 10) | (years >= 3), "Relevant Experience"),
        F.when(F.coalesce("open_to_work", F.lit(False)), "Open to Work"),
        F.when(~_flagged(), "Verified Timeline"),
        F.when(years >= 8, "Domain Experience"),
        F.when(F.coalesce("recruiter_response_rate", F.lit(0.0)) >= 0.8, "High Recruiter Response"))
    kept = F.filter(rules, lambda b: b.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("Strong Profile")))


def concise_summary() -> Column:
    """E09."""
    role = F.coalesce(F.nullif("current_title", F.lit("")), F.lit("Candidate"))
    company = F.nullif("current_company", F.lit(""))
    matched = _clean(_list(F.coalesce("matched_skills", "critical_skills_matched")))
    missing = _clean(_list(F.coalesce("missing_skills", "missing_critical_skills")))
    days = F.col("notice_period_days")
    return F.concat(
        role, F.coalesce(F.concat(F.lit(" at "), company), F.lit("")),
        F.coalesce(F.format_string(" with %.1f years of experience", F.col(YEARS)), F.lit("")), F.lit("."),
        F.when(F.size(matched) > 0, F.concat(
            F.lit(" Strong evidence for "), F.array_join(matched, ", "), F.lit("."))).otherwise(""),
        F.when(F.size(missing) > 0, F.concat(
            F.lit(" Documented gaps include "), F.array_join(missing, ", "), F.lit(".")))
        .otherwise(" No major critical skill gaps identified."),
        F.when(~F.coalesce("open_to_work", F.lit(False)), "").when(days.isNotNull(), F.concat(
            F.lit(" Open to Work with a "), days.cast("string"), F.lit("-day notice period.")))
        .otherwise(" Open to Work."))


def strength_list() -> Column:
    """E10."""
    names = _clean(_list(F.coalesce(F.col("matched_skills"), F.concat(
        _list("critical_skills_matched"), _list("important_skills_matched")))))
    verified = F.when(F.size(names) > 0, F.transform(names, lambda s: F.concat(F.lit("Verified coverage: "), s))
                      ).otherwise(F.array(F.lit("General technical domain background.")))
    notes = F.filter(F.array(
        F.when(~_flagged(), "Timeline integrity clear: no duration anomalies."),
        F.when(F.coalesce("open_to_work", F.lit(False)), "Actively seeking opportunities (Open to Work).")),
        lambda x: x.isNotNull())
    return F.concat(verified, notes)


def gap_list() -> Column:
    """A gap that a matched name covers, as a whole word inside it, is left out."""
    matched = F.transform(_clean(F.concat(
        _list("critical_skills_matched"), _list("important_skills_matched"), _list("nice_to_have_skills_matched"),
        _list("matched_skills"))), lambda s: F.struct(
        F.lower(s).alias("name"), mark_literal(F.lower(s)).alias("find")))
    missing = F.transform(_clean(_list(F.coalesce("missing_skills", "missing_critical_skills"))), lambda s: F.struct(
        s.alias("text"), F.lower(s).alias("low"), mark_bounds(F.lower(s)).alias("mark")))

    def open_gaps(known: Column) -> Column:
        return F.filter(missing, lambda g: ~F.exists(known, lambda m: (m["name"] == g["low"]) | (
            (F.length(m["name"]) >= 2) & bounded_in(m["find"], g["mark"]))))
    lines = F.transform(let(matched, open_gaps), lambda g: F.concat(
        F.lit("Lacks documented evidence for: "), g["text"]))
    days = F.col("notice_period_days")
    before = F.filter(F.array(F.when(
        _flagged(), "Chronological anomalies detected in career history duration records.")), lambda x: x.isNotNull())
    after = F.filter(F.array(F.when(days >= 60, F.concat(
        F.lit("Long notice period requirement ("), days.cast("string"), F.lit(" days).")))), lambda x: x.isNotNull())
    return F.concat(before, lines, after)
