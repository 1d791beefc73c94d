"""A01-A14."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions.fixed_values import RELEASE_YEARS
from candisieve.operators import anomaly as an
from candisieve.operators.profile import build_profile
from workloads import testbed as tb
from workloads.registry import query

CAND = tb.with_flat("cand")
JOB = tb.with_flat("cand", "cand_job")

# An unreadable date is no date; the derived dates are either readable or plain words.
def d_date(c: str) -> str:
    return f"try_cast({c} AS DATE)"


D_FLAG_SALARY = "salary_min > salary_max"
D_FLAG_ACTIVITY = f"coalesce({d_date('last_active_date')} < {d_date('signup_date')}, false)"
D_FLAG_JOB_DATES = f"""(SELECT DISTINCT candidate_id FROM cand_job
  WHERE {d_date('end_date')} < {d_date('start_date')} OR year({d_date('start_date')}) > 2026)"""
D_FLAG_LENGTH = """(SELECT DISTINCT c.candidate_id FROM cand c JOIN cand_job j USING (candidate_id)
  WHERE j.months / 12.0 > c.years + 0.5)"""
D_OVERLAP = f"""(SELECT DISTINCT candidate_id FROM (
  SELECT candidate_id, company, e, lead(company) OVER w AS next_company, lead(s) OVER w AS next_s FROM (
    SELECT candidate_id, pos, company, {d_date('start_date')} AS s,
      CASE WHEN end_date IS NULL THEN DATE '2026-07-02' ELSE {d_date('end_date')} END AS e FROM cand_job)
  WHERE s IS NOT NULL AND e IS NOT NULL WINDOW w AS (PARTITION BY candidate_id ORDER BY s, pos))
  WHERE company <> next_company AND date_diff('day', next_s, e) > 90)"""
D_SENIOR = "regexp_matches(lower(title), 'principal|architect|lead|director|chief|cto|vp')"
D_PROMOTION = f"""(SELECT c.candidate_id, arg_min(j.title, j.pos) AS title FROM cand c JOIN cand_job j USING (candidate_id)
  WHERE c.years < 1.5 AND regexp_matches(lower(j.title), 'principal|architect|lead|director|chief|cto|vp') GROUP BY 1)"""
D_TENURE = """(SELECT c.candidate_id, CAST(sum(j.months) AS DOUBLE) / 12 AS job_years FROM cand c JOIN cand_job j USING (candidate_id)
  GROUP BY c.candidate_id, c.years HAVING CAST(sum(j.months) AS DOUBLE) / 12 > c.years + 5)"""
D_EDUCATION = """(SELECT candidate_id FROM cand_edu GROUP BY 1 HAVING bool_or(end_year < start_year)
  OR max_by(end_year, start_year * 10 + pos) FILTER (regexp_matches(lower(degree), 'high school|hsc|matric'))
   > max_by(end_year, start_year * 10 + pos) FILTER (NOT regexp_matches(lower(degree), 'high school|hsc|matric')
     AND regexp_matches(lower(degree), 'bachelor|b\\.s|b\\.e|b\\.tech|college')))"""
D_EXPERT = """(SELECT candidate_id, count(*) AS n FROM cand_skill
  WHERE lower(proficiency) IN ('expert', 'advanced', 'lead') GROUP BY 1 HAVING count(*) > 15)"""
D_ENDORSE = "(endorsements_received > 300 AND (years < 1.5 OR connections < 15))"
_RELEASES = " OR ".join(
    f"(regexp_matches(lower(name), '\\b{name.replace('.', chr(92) + '.')}\\b') AND coalesce(months, 0) / 12.0 > {2026 - year + 0.5})"
    for name, year in RELEASE_YEARS.items())
D_RELEASE = f"(SELECT DISTINCT candidate_id FROM cand_skill WHERE {_RELEASES})"
D_PHD = """(regexp_matches(lower(headline || ' ' || summary), 'phd|ph\\.d') AND candidate_id NOT IN (
  SELECT candidate_id FROM cand_edu WHERE regexp_matches(lower(degree), 'phd|ph\\.d|doctor')))"""

ALL_CAND = ("cand", "cand_skill", "cand_job", "cand_edu")
# Per candidate: hard flag, each penalty, confidence.
D_CONFIDENCE = f"""(SELECT *, hard_flag OR confidence_score < 40 AS is_honeypot FROM (
  SELECT *, greatest(0, 100 - 15 * p_overlap - 20 * p_promotion - 20 * p_tenure - 20 * p_education - 15 * p_expert
    - 15 * p_endorse - 30 * p_release - 15 * p_phd)::DOUBLE AS confidence_score FROM (
  SELECT c.*, ({D_FLAG_SALARY}) OR ({D_FLAG_ACTIVITY}) OR fd.candidate_id IS NOT NULL OR fl.candidate_id IS NOT NULL AS hard_flag,
    (ov.candidate_id IS NOT NULL)::INT AS p_overlap, (pr.candidate_id IS NOT NULL)::INT AS p_promotion, pr.title AS senior_title,
    (te.candidate_id IS NOT NULL)::INT AS p_tenure, te.job_years, (ed.candidate_id IS NOT NULL)::INT AS p_education,
    (ex.candidate_id IS NOT NULL)::INT AS p_expert, ex.n AS n_expert, {D_ENDORSE}::INT AS p_endorse,
    (re.candidate_id IS NOT NULL)::INT AS p_release, {D_PHD.replace('candidate_id NOT IN', 'c.candidate_id NOT IN')}::INT AS p_phd
  FROM cand c LEFT JOIN {D_FLAG_JOB_DATES} fd USING (candidate_id) LEFT JOIN {D_FLAG_LENGTH} fl USING (candidate_id)
  LEFT JOIN {D_OVERLAP} ov USING (candidate_id) LEFT JOIN {D_PROMOTION} pr USING (candidate_id)
  LEFT JOIN {D_TENURE} te USING (candidate_id) LEFT JOIN {D_EDUCATION} ed USING (candidate_id)
  LEFT JOIN {D_EXPERT} ex USING (candidate_id) LEFT JOIN {D_RELEASE} re USING (candidate_id)) a) b)"""


def _profiles(spark, sf, *parts):
    return build_profile(tb.candidates(spark, sf, parts))


def _hits(name, check, column, *parts):
    @query(name, check)
    def run(spark, sf, column=column, parts=parts):
        return _profiles(spark, sf, *parts).filter(column()).select("candidate_id")
    return run


_hits("a01_salary_inversion", CAND + f"SELECT candidate_id FROM cand WHERE {D_FLAG_SALARY}", an.flag_salary)
_hits("a02_activity_before_signup", CAND + f"SELECT candidate_id FROM cand WHERE {D_FLAG_ACTIVITY}", an.flag_activity_dates)
_hits("a03_job_dates", JOB + f"SELECT candidate_id FROM {D_FLAG_JOB_DATES}", an.flag_job_dates, "career_history")
_hits("a04_job_longer_than_experience", JOB + f"SELECT candidate_id FROM {D_FLAG_LENGTH}", an.flag_job_length, "career_history")
_hits("a05_job_overlap", JOB + f"SELECT candidate_id FROM {D_OVERLAP}", an.has_overlap, "career_history")
_hits("a08_education_timeline", tb.with_flat("cand_edu") + f"SELECT candidate_id FROM {D_EDUCATION}",
      an.has_education_anomaly, "education")
_hits("a10_endorsement_inflation", CAND + f"SELECT candidate_id FROM cand WHERE {D_ENDORSE}", an.has_endorsement_anomaly)
_hits("a11_technology_release", tb.with_flat("cand_skill") + f"SELECT candidate_id FROM {D_RELEASE}",
      an.has_release_anomaly, "skills")
_hits("a12_doctorate_claim", tb.with_flat("cand", "cand_edu") + f"SELECT candidate_id FROM cand WHERE {D_PHD}",
      an.has_phd_anomaly, "education")


@query("a06_early_senior_title", JOB + f"SELECT candidate_id, title AS first_senior_title FROM {D_PROMOTION}")
def a06(spark, sf):
    return _profiles(spark, sf, "career_history").filter(an.has_promotion_anomaly()).select(
        "candidate_id", F.get(an.senior_titles(), F.lit(0)).alias("first_senior_title"))


@query("a07_total_tenure", JOB + f"SELECT candidate_id, round(job_years, 6) AS job_years FROM {D_TENURE}")
def a07(spark, sf):
    return _profiles(spark, sf, "career_history").filter(an.has_tenure_anomaly()).select(
        "candidate_id", F.round(an.total_job_years(), 6).alias("job_years"))


@query("a09_expert_count", tb.with_flat("cand_skill") + f"SELECT candidate_id, n AS n_expert FROM {D_EXPERT}")
def a09(spark, sf):
    return _profiles(spark, sf, "skills").filter(an.has_expert_anomaly()).select(
        "candidate_id", an.expert_count().cast("long").alias("n_expert"))


@query("a13_confidence", tb.with_flat(*ALL_CAND) + f"""
SELECT candidate_id, confidence_score, hard_flag, is_honeypot, concat_ws(' | ',
  CASE WHEN p_overlap = 1 THEN 'Chronological Overlaps: concurrent full-time jobs overlapping by > 3 months' END,
  CASE WHEN p_promotion = 1 THEN 'Promotion Anomaly: role ''' || senior_title || ''' with < 1.5 years of total experience' END,
  CASE WHEN p_tenure = 1 THEN 'Job duration sum (' || printf('%.1f', job_years)
    || ' years) significantly exceeds total experience (' || CAST(years AS VARCHAR) || ' years)' END,
  CASE WHEN p_education = 1 THEN 'Education Timeline Anomaly: inconsistent high school / college graduation dates' END,
  CASE WHEN p_expert = 1 THEN 'Unrealistic Skill Claims: expert/advanced proficiency in ' || n_expert || ' distinct technologies' END,
  CASE WHEN p_endorse = 1 THEN 'Suspicious Endorsement Inflation: ' || endorsements_received || ' endorsements with low experience/connections' END,
  CASE WHEN p_release = 1 THEN 'Technology Release Anomaly: technology usage duration exceeds release history' END,
  CASE WHEN p_phd = 1 THEN 'Contradictory Profile Information: PhD claimed in summary/headline but not listed in education' END) AS reasons
FROM {D_CONFIDENCE} x""")
def a13(spark, sf):
    c = an.with_confidence(_profiles(spark, sf, "career_history", "education", "skills"))
    return c.select("candidate_id", "confidence_score", "hard_flag", "is_honeypot",
                    F.array_join("confidence_penalties", " | ").alias("reasons"))


# A ranked list whose score is read off the profile, with many equal (name, years, title).
_SCORES = """scored AS (SELECT a.job_id, c.candidate_id, c.name, c.years, c.title,
    CAST((c.custkey * 37) % 101 AS DOUBLE) AS final_score, CAST(c.custkey % 11 AS DOUBLE) AS behavior_score
  FROM application a JOIN cand c USING (candidate_id))"""


@query("a14_duplicate_demotion", tb.with_flat("cand", "application").rstrip() + f""", {_SCORES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, behavior_score DESC, candidate_id) AS r FROM scored),
marked AS (SELECT *, r <= 100 AND row_number() OVER (PARTITION BY job_id, r <= 100, lower(trim(name)), years, lower(trim(title)) ORDER BY r) > 1 AS is_duplicate FROM ranked)
SELECT job_id, candidate_id, is_duplicate,
  CASE WHEN is_duplicate THEN round(final_score * 0.1, 4) ELSE final_score END AS final_score FROM marked""")
def a14(spark, sf):
    cand, apps = tb.flat(spark, sf, "cand"), tb.applications(spark, sf)
    scored = apps.join(cand, "candidate_id").selectExpr(
        "job_id", "candidate_id", "name", "years AS years_of_experience", "title AS current_title",
        "cast((custkey * 37) % 101 AS double) AS final_score", "cast(custkey % 11 AS double) AS behavior_score")
    return an.demote_duplicates(scored).select("job_id", "candidate_id", "is_duplicate", "final_score")
