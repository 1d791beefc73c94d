"""K01-K17 and the funnel R13."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions import fixed_values as fv
from candisieve.functions.vectors import as_vector
from candisieve.operators import anomaly as an
from candisieve.operators import scoring as sc
from candisieve.operators import skills as sk
from candisieve.operators.profile import build_profile
from workloads import testbed as tb
from workloads.anomaly_queries import D_CONFIDENCE
from workloads.registry import d_array, d_list, d_raw, query
from workloads.retrieval_queries import CAND_VEC, D_COS, JOB_VEC, ROLE_VEC, d_vectors, vectors
from workloads.skill_queries import D_ANALYSIS, beside_job, synonyms
from workloads.skill_sql import D_CLASSIFIED, D_JOB_SIDE, D_LADDER, D_RARITY, d_escape

FLAT_ALL = tb.with_flat("cand", "cand_skill", "cand_job", "cand_edu", "cand_cert", "job", "job_line", "job_tech", "application").rstrip()

D_CONTRIB = f"""{D_RARITY},
recent AS (SELECT candidate_id, lower(description) AS d, lower(title) AS t FROM cand_job WHERE pos = 1),
mult AS (SELECT c.*, coalesce(r.rarity, 1)::DOUBLE AS rarity,
    CASE WHEN c.skill IS NULL OR c.is_cert_hit THEN 1.0 WHEN contains(lower(proficiency), 'expert') THEN 1.2
      WHEN regexp_matches(lower(proficiency), 'advanced|lead') THEN 1.1 WHEN contains(lower(proficiency), 'intermediate') THEN 1.0 ELSE 0.7 END::DOUBLE AS m_prof,
    CASE WHEN c.skill IS NULL OR c.is_cert_hit THEN 1.0 WHEN months >= 36 THEN 1.0 WHEN months >= 12 THEN 0.9 WHEN months > 0 THEN 0.8 ELSE 0.7 END::DOUBLE AS m_dur,
    CASE WHEN contains(h.d, lower(c.line)) OR contains(h.t, lower(c.line))
      OR (coalesce(c.skill, '') <> '' AND (contains(h.d, lower(c.skill)) OR contains(h.t, lower(c.skill)))) THEN 1.2 ELSE 1.0 END::DOUBLE AS m_rec
  FROM classified c LEFT JOIN rarity r ON r.job_id = c.job_id AND r.skill = c.norm LEFT JOIN recent h ON h.candidate_id = c.candidate_id),
contrib AS (SELECT *, CASE WHEN cls IN ('DIRECT', 'EQUIVALENT') THEN m_prof * m_dur * m_rec * 10 * weight * rarity
    WHEN cls = 'SUPPORTED' THEN 5 * weight * rarity WHEN is_critical THEN -3 * rarity ELSE 0 END AS points FROM mult),
n_critical AS (SELECT job_id, count(*) AS n FROM critical GROUP BY 1),
skill_points AS (SELECT job_id, candidate_id, greatest(0, least(40, CASE WHEN sum(weight) > 0 THEN 40 * (sum(points) / sum(10 * weight)) ELSE 0 END
    - CASE WHEN coalesce(any_value(n.n), 2) >= 2 AND NOT bool_or(is_critical AND cls IN ('DIRECT', 'EQUIVALENT')) THEN 20 ELSE 0 END))::DOUBLE AS skill_score
  FROM contrib LEFT JOIN n_critical n USING (job_id) GROUP BY 1, 2)"""
CONTRIB_SQL = f"{FLAT_ALL}, {D_JOB_SIDE}, {D_LADDER}, {D_CLASSIFIED}, {D_CONTRIB}\n"


def ready_pairs(spark, sf):
    """Applicants beside their job, prepared, with cohort rarity."""
    cand = tb.candidates(spark, sf)
    ready = sk.prepare_candidates(build_profile(cand)).select(
        "candidate_id", "skill_units", "cert_units", "title_texts", "career_lower", "career_history")
    apps = tb.applications(spark, sf)
    rarity = sk.skill_rarity(apps.join(tb.candidates(spark, sf, ("skills",)).select("candidate_id", "skills"), "candidate_id"))
    job = sk.attach_rarity(sk.prepare_jobs(tb.jobs(spark, sf)), rarity).select("job_id", "units", "atomic", "critical", "rarity")
    return sc.with_contributions(sk.classify(beside_job(spark, sf, ready, job)))


def _points(name, keep, where):
    @query(name, CONTRIB_SQL + f"""SELECT job_id, candidate_id, CAST(idx AS BIGINT) AS req_idx, cls, round(points, 4) AS points
FROM contrib WHERE {where}""")
    def run(spark, sf):
        rows = ready_pairs(spark, sf).select("job_id", "candidate_id", F.explode("classified").alias("c"))
        return rows.filter(keep).select("job_id", "candidate_id", F.col("c.idx").alias("req_idx"), "c.cls",
                                        F.round("c.points", 4).alias("points"))


_points("k01_match_contribution", "c.cls IN ('DIRECT', 'EQUIVALENT')", "cls IN ('DIRECT', 'EQUIVALENT')")
_points("k02_support_and_miss", "c.cls = 'SUPPORTED' OR (c.cls IN ('NONE', 'RELATED') AND c.is_critical)",
        "cls = 'SUPPORTED' OR (cls IN ('NONE', 'RELATED') AND is_critical)")


@query("k03_skill_score", CONTRIB_SQL + "SELECT job_id, candidate_id, round(skill_score, 4) AS skill_score FROM skill_points")
def k03(spark, sf):
    return ready_pairs(spark, sf).select("job_id", "candidate_id", F.round(sc.skill_score(), 4).alias("skill_score"))


def _d_tier(where: str) -> str:
    return f"coalesce(string_agg(line, ' | ' ORDER BY idx) FILTER ({where}), '')"


D_TIERS = f"""tiers AS (SELECT job_id, candidate_id,
  {_d_tier("is_critical AND cls IN ('DIRECT', 'EQUIVALENT')")} AS critical_skills_matched,
  {_d_tier("NOT is_critical AND weight >= 0.8 AND cls IN ('DIRECT', 'EQUIVALENT', 'SUPPORTED')")} AS important_skills_matched,
  {_d_tier("NOT is_critical AND weight < 0.8 AND cls IN ('DIRECT', 'EQUIVALENT', 'SUPPORTED')")} AS nice_to_have_skills_matched,
  {_d_tier("is_critical AND cls NOT IN ('DIRECT', 'EQUIVALENT')")} AS missing_critical_skills FROM classified GROUP BY 1, 2)"""


@query("k04_tier_lists", f"{FLAT_ALL}, {D_JOB_SIDE}, {D_LADDER}, {D_CLASSIFIED}, {D_TIERS} SELECT * FROM tiers")
def k04(spark, sf):
    return ready_pairs(spark, sf).select("job_id", "candidate_id", *[
        F.array_join(c, " | ").alias(n) for n, c in sc.tier_lists().items()])


D_SIMS = f"""cv AS ({d_vectors(CAND_VEC)}), jv AS ({d_vectors(JOB_VEC)}), rv AS ({d_vectors(ROLE_VEC)}),
role_sim AS (SELECT a.job_id, a.candidate_id, max({D_COS.format('rv.embedding', 'jv.job_embedding')}) AS s
  FROM application a JOIN rv USING (candidate_id) JOIN jv ON jv.job_id = a.job_id GROUP BY 1, 2),
sims AS (SELECT a.job_id, a.candidate_id, {D_COS.format('cv.embedding', 'jv.job_embedding')} AS sim, coalesce(r.s, 0) AS role_sim
  FROM application a JOIN cv USING (candidate_id) JOIN jv ON jv.job_id = a.job_id LEFT JOIN role_sim r ON r.job_id = a.job_id AND r.candidate_id = a.candidate_id)"""
_any = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_count = lambda c, words: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"
D_EXPERIENCE = f"""exper AS (SELECT s.job_id, s.candidate_id, greatest(0, least(25,
    CASE WHEN c.years < j.min_years THEN greatest(0, 8 * (c.years / j.min_years)) ELSE 8 END
    + greatest(0, least(7, 7 * (s.sim - 0.2::DOUBLE) / 0.7::DOUBLE))
    + CASE WHEN h.notable THEN 0.75 ELSE 0 END + CASE WHEN h.lead THEN 2 ELSE 0 END + least(5, coalesce(h.scale, 0))
    + greatest(0, least(3, 3 * s.role_sim))))::DOUBLE AS experience_score
  FROM sims s JOIN cand c USING (candidate_id) JOIN job j ON j.job_id = s.job_id LEFT JOIN (
    SELECT candidate_id, bool_or({_any('lower(company)', fv.NOTABLE_EMPLOYERS)}) AS notable,
      bool_or({_any('lower(title)', fv.LEADERSHIP_WORDS)}) AS lead, {_count("lower(string_agg(description, ' ' ORDER BY pos))", fv.SCALE_WORDS)} AS scale
    FROM cand_job GROUP BY 1) h ON h.candidate_id = s.candidate_id)"""


def cand_vectors(spark, sf):
    roles = vectors(spark, sf, ROLE_VEC).groupBy("candidate_id").agg(
        F.collect_list(as_vector("embedding")).alias("role_embeddings"))
    return vectors(spark, sf, CAND_VEC).select("candidate_id", as_vector("embedding").alias("embedding")).join(
        roles, "candidate_id", "left")


def job_vectors(spark, sf):
    v = as_vector("job_embedding")
    return vectors(spark, sf, JOB_VEC).select("job_id", v.alias("job_embedding"), v.alias("title_embedding"))


@query("k05_experience_score", f"{FLAT_ALL}, {D_SIMS}, {D_EXPERIENCE} SELECT job_id, candidate_id, round(experience_score, 4) AS experience_score FROM exper")
def k05(spark, sf):
    from candisieve.functions.vectors import dot, l2_normalize, max_similarity
    p = build_profile(tb.candidates(spark, sf, ("career_history",))).select("candidate_id", "career_history", sc.YEARS)
    rows = (tb.applications(spark, sf).join(p, "candidate_id").join(cand_vectors(spark, sf), "candidate_id", "left")
            .join(job_vectors(spark, sf), "job_id", "left").join(tb.flat(spark, sf, "job").select("job_id", "min_years"), "job_id"))
    unit = lambda c: l2_normalize(as_vector(c))
    roles = F.transform("role_embeddings", lambda v: l2_normalize(as_vector(v)))
    score = sc.experience_score(F.col("min_years"), dot(unit("embedding"), unit("job_embedding")),
                                max_similarity(roles, unit("title_embedding")))
    return rows.select("job_id", "candidate_id", F.round(score, 4).alias("experience_score"))


D_EDUCATION_SCORE = f"""edu AS (SELECT c.candidate_id, least(10, coalesce(e.rel, 4) + coalesce(e.deg, 0))::DOUBLE AS education_score FROM cand c LEFT JOIN (
  SELECT candidate_id, CASE WHEN bool_or({_any('lower(field)', fv.FIELDS_BEST)}) THEN 8 WHEN bool_or({_any('lower(field)', fv.FIELDS_GOOD)}) THEN 6 ELSE 4 END AS rel,
    CASE WHEN bool_or({_any('lower(degree)', fv.DEGREES_DOCTOR)}) THEN 2 WHEN bool_or({_any('lower(degree)', fv.DEGREES_MASTER)}) THEN 1 ELSE 0 END AS deg
  FROM cand_edu GROUP BY 1) e USING (candidate_id))"""


@query("k06_education_score", tb.with_flat("cand", "cand_edu").rstrip() + f", {D_EDUCATION_SCORE} SELECT * FROM edu")
def k06(spark, sf):
    return tb.candidates(spark, sf, ("education",)).select("candidate_id", sc.education_score().alias("education_score"))


_ascii = lambda c: f"regexp_replace({c}, '[À-ÖØ-öø-ÿ]', '_', 'g')"
_VERBS = "|".join(fv.EVIDENCE_VERBS)
_METRICS = "|".join(fv.EVIDENCE_METRICS)
D_EVIDENCE = rf"""ev_text AS (SELECT c.candidate_id, {d_raw('c.summary')} || ' ' || {d_raw('c.headline')} || ' ' || coalesce(j.d, '') || ' ' || coalesce(j.t, '') AS text
  FROM cand c LEFT JOIN (SELECT candidate_id, string_agg(description, ' ' ORDER BY pos) AS d, string_agg(title, ' ' ORDER BY pos) AS t FROM cand_job GROUP BY 1) j USING (candidate_id)),
sentence AS (SELECT candidate_id, pos, s, low, {_ascii('low')} AS alow FROM (SELECT candidate_id, pos, trim(s) AS s, lower(trim(s)) AS low FROM (
    SELECT candidate_id, unnest(string_split_regex(text, '[.\n\r;]+')) AS s, generate_subscripts(string_split_regex(text, '[.\n\r;]+'), 1) AS pos FROM ev_text)) x
  WHERE length(s) > 10),
said AS (SELECT *, regexp_extract(alow, '\b({_VERBS})\b', 1) AS verb,
    regexp_matches(alow, '\b\d') OR contains(low, '%') OR regexp_matches(alow, '\b({_METRICS})\b') AS strong
  FROM sentence WHERE regexp_matches(alow, '\b({_VERBS})\b')),
said_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, low ORDER BY pos) AS r FROM said) WHERE r = 1),
tech_word AS (SELECT job_id, lower(trim(line)) AS tech FROM job_line UNION SELECT job_id, unnest({d_array(fv.EVIDENCE_TECH)}) FROM job),
tech_sentence AS (SELECT t.tech, s.alow FROM (SELECT DISTINCT tech FROM tech_word) t CROSS JOIN (SELECT DISTINCT alow FROM said_once) s
  WHERE CASE WHEN contains(t.tech, ' ') THEN contains(s.alow, t.tech) ELSE contains(s.alow, t.tech) AND regexp_matches(s.alow, '\b' || {d_escape('t.tech')} || '\b') END),
evidence AS (SELECT a.job_id, a.candidate_id, s.pos, any_value(s.s) AS sentence, any_value(s.verb) AS verb, min(t.tech) AS tech, bool_or(s.strong) AS strong
  FROM application a JOIN said_once s USING (candidate_id) JOIN tech_sentence ts ON ts.alow = s.alow JOIN tech_word t ON t.job_id = a.job_id AND t.tech = ts.tech GROUP BY 1, 2, 3),
density AS (SELECT a.job_id, a.candidate_id, least(25, coalesce(sum(CASE WHEN e.pos IS NULL THEN 0 WHEN e.strong THEN 5 ELSE 2 END), 0))::DOUBLE AS density
  FROM application a LEFT JOIN evidence e USING (job_id, candidate_id) GROUP BY 1, 2)"""
EVIDENCE_SQL = tb.with_flat("cand", "cand_job", "job", "job_line", "application").rstrip() + f", {D_EVIDENCE}\n"


def _evidence(spark, sf):
    p = build_profile(tb.candidates(spark, sf, ("career_history",))).select("candidate_id", "summary", "headline", "career_history")
    rows = beside_job(spark, sf, p, tb.jobs(spark, sf).select("job_id", "requirements", "preferred_skills"))
    return rows.withColumn("found", sc.evidence_snippets(F.col("requirements"), F.col("preferred_skills")))


@query("k07_evidence_density", EVIDENCE_SQL + "SELECT job_id, candidate_id, density AS evidence_density FROM density")
def k07(spark, sf):
    return _evidence(spark, sf).select("job_id", "candidate_id", sc.evidence_density(F.col("found")).alias("evidence_density"))


@query("k08_evidence_snippets", EVIDENCE_SQL + """SELECT job_id, candidate_id, sentence, CASE WHEN strong THEN 'strong' ELSE 'medium' END AS quality,
  verb, tech, CASE WHEN strong THEN 'numerical/metric' ELSE 'none' END AS impact FROM evidence""")
def k08(spark, sf):
    return _evidence(spark, sf).select("job_id", "candidate_id", F.inline("found"))


@query("k09_project_score", EVIDENCE_SQL + "SELECT job_id, candidate_id, least(10, density)::DOUBLE AS project_score FROM density")
def k09(spark, sf):
    return _evidence(spark, sf).select("job_id", "candidate_id", sc.project_score(
        sc.evidence_density(F.col("found"))).alias("project_score"))


D_BEHAVIOR = """greatest(0, least(10, 2 * (completeness / 100) + 2 * response_rate + 2 * interview_rate
  + least(2, connections::DOUBLE / 1000 + endorsements_received::DOUBLE / 100)
  + 2 * ((verified_email::INT + verified_phone::INT + linkedin::INT)::DOUBLE / 3)))::DOUBLE"""
D_AVAILABILITY = """least(5, CASE WHEN notice_days = 0 OR open_to_work THEN 4.0 WHEN notice_days <= 15 THEN 3.5 WHEN notice_days <= 30 THEN 3.0
  WHEN notice_days <= 60 THEN 2.0 WHEN notice_days <= 90 THEN 1.0 ELSE 0.5 END + CASE WHEN open_to_work THEN 1 ELSE 0 END)::DOUBLE"""
D_MODIFIER = """(CASE WHEN completeness > 85 AND response_rate > 0.8 THEN 0.03::DOUBLE WHEN completeness < 50 OR response_rate < 0.4 THEN -0.05::DOUBLE ELSE 0 END
  + CASE WHEN year(try_cast(last_active_date AS DATE)) < 2026 THEN -0.03::DOUBLE ELSE 0 END
  + CASE WHEN open_to_work THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN notice_days >= 90 THEN -0.01::DOUBLE ELSE 0 END)"""


def _signal_score(name, alias, column, check):
    @query(name, tb.with_flat("cand") + f"SELECT candidate_id, round({check}, 6) AS {alias} FROM cand")
    def run(spark, sf):
        return tb.candidates(spark, sf, ()).select("candidate_id", F.round(column(), 6).alias(alias))


_signal_score("k10_behavior_score", "behavior_score", sc.behavior_score, D_BEHAVIOR)
_signal_score("k11_availability_score", "availability_score", sc.availability_score, D_AVAILABILITY)
_signal_score("k12_modifier", "modifier", sc.modifier, D_MODIFIER)


# The whole score of every applicant.
D_SCORED = f"""conf AS (SELECT * FROM {D_CONFIDENCE} z),
parts AS (SELECT a.job_id, a.candidate_id, f.name, f.years, f.title, f.is_honeypot, f.confidence_score, s.skill_score, x.experience_score, e.education_score,
    least(10, d.density) AS project_score, {D_BEHAVIOR} AS behavior_score, {D_AVAILABILITY} AS availability_score, {D_MODIFIER} AS modifier
  FROM application a JOIN conf f USING (candidate_id) JOIN skill_points s USING (job_id, candidate_id) JOIN exper x USING (job_id, candidate_id)
  JOIN edu e ON e.candidate_id = a.candidate_id JOIN density d ON d.job_id = a.job_id AND d.candidate_id = a.candidate_id),
summed AS (SELECT *, skill_score + experience_score + education_score + project_score + behavior_score + availability_score AS base FROM parts),
scored AS (SELECT job_id, candidate_id, name, years, title, is_honeypot, confidence_score,
    {", ".join(f"CASE WHEN is_honeypot THEN 0 ELSE round({p}, 4) END::DOUBLE AS {p}" for p in sc.BREAKDOWN)},
    CASE WHEN is_honeypot THEN 0 ELSE round(greatest(0, least(100, base * (1 + modifier))), 4) END::DOUBLE AS final_score,
    CASE WHEN is_honeypot THEN 0 ELSE round(round(greatest(0, least(100, base * (1 + modifier))), 4) - base, 4) END::DOUBLE AS engagement_bonus FROM summed)"""
D_RANKED = """before AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, behavior_score DESC, candidate_id) AS r FROM scored),
marked AS (SELECT * EXCLUDE (final_score, r), is_duplicate, CASE WHEN is_duplicate THEN round(final_score * 0.1, 4) ELSE final_score END AS final_score FROM (
  SELECT *, r <= 100 AND row_number() OVER (PARTITION BY job_id, r <= 100, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), years, lower(trim(title)) ORDER BY r) > 1 AS is_duplicate FROM before)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, behavior_score DESC, candidate_id) AS rank FROM marked) WHERE rank <= 100)"""
D_RANKED = D_RANKED.replace("* EXCLUDE (final_score, r), is_duplicate,", "* EXCLUDE (final_score, r, is_duplicate), is_duplicate,")
SCORED_SQL = f"{FLAT_ALL}, {D_JOB_SIDE}, {D_LADDER}, {D_CLASSIFIED}, {D_CONTRIB}, {D_SIMS}, {D_EXPERIENCE}, {D_EDUCATION_SCORE}, {D_EVIDENCE}, {D_SCORED}"
RANKED_SQL = f"{SCORED_SQL}, {D_RANKED}\n"


def scored(spark, sf, cohort=None):
    cohort = tb.applications(spark, sf) if cohort is None else cohort
    return sc.score_cohort(cohort, tb.jobs(spark, sf), tb.candidates(spark, sf), cand_vectors(spark, sf),
                           job_vectors(spark, sf), synonyms(spark))


@query("k13_final_score", SCORED_SQL + """ SELECT job_id, candidate_id, is_honeypot, final_score, engagement_bonus FROM scored""")
def k13(spark, sf):
    return scored(spark, sf).select("job_id", "candidate_id", "is_honeypot", "final_score", "engagement_bonus")


_RANK_COLUMNS = ["job_id", "candidate_id", "rank", "final_score", *sc.BREAKDOWN, "is_honeypot"]


@query("k14_rank_top", SCORED_SQL + """ SELECT job_id, candidate_id, rank, final_score FROM (SELECT *,
row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, behavior_score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 100""")
def k14(spark, sf):
    return sc.rank_top(scored(spark, sf)).select("job_id", "candidate_id", "rank", "final_score")


# Each applicant against the job alone: the cohort plays no part, so rarity is 1.
NO_RARITY_SQL = SCORED_SQL.replace("coalesce(r.rarity, 1)::DOUBLE AS rarity", "1::DOUBLE AS rarity")


@query("k15_score_pairs", NO_RARITY_SQL + " SELECT job_id, candidate_id, skill_score, final_score FROM scored")
def k15(spark, sf):
    out = sc.score_pairs(tb.applications(spark, sf), tb.candidates(spark, sf), tb.jobs(spark, sf),
                         vectors=cand_vectors(spark, sf), job_vectors=job_vectors(spark, sf), synonyms=synonyms(spark))
    return out.select("job_id", "candidate_id", "skill_score", "final_score")


@query("k16_score_cohort", RANKED_SQL + f"SELECT {', '.join(_RANK_COLUMNS)}, is_duplicate FROM ranked")
def k16(spark, sf):
    return sc.rank_cohort(scored(spark, sf)).select(*_RANK_COLUMNS, "is_duplicate")


@query("k17_honeypot_counts", FLAT_ALL + f""", conf AS (SELECT * FROM {D_CONFIDENCE} z)
SELECT a.job_id, count(*) FILTER (f.is_honeypot) AS honeypots, count(*) FILTER (NOT f.is_honeypot) AS clear
FROM application a JOIN conf f USING (candidate_id) GROUP BY 1""")
def k17(spark, sf):
    flags = an.with_confidence(build_profile(tb.candidates(spark, sf, ("career_history", "education", "skills")))).select(
        "candidate_id", "is_honeypot")
    return sc.honeypot_counts(tb.applications(spark, sf).join(flags, "candidate_id"))
