"""P01-P17."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions import text as tx
from candisieve.operators import profile as pf
from workloads import testbed as tb
from workloads.registry import d_norm, d_raw, d_strip, query

CAND = tb.with_flat("cand")
SKILL = tb.with_flat("cand", "cand_skill")
JOB = tb.with_flat("cand", "cand_job")

_job_text = "coalesce(title, '') || ' ' || coalesce(company, '') || ' ' || coalesce(description, '')"
D_WORK = f"(SELECT candidate_id, {d_norm(f'''string_agg({_job_text}, ' ' ORDER BY pos)''')} AS work_history_text FROM cand_job GROUP BY 1)"
D_PROFILE = d_norm(" || ' ' || ".join(d_raw(c) for c in ["name", "headline", "summary", "title", "company"]))
D_NORM_SKILLS = f"""(SELECT candidate_id, string_agg(nm, '@' ORDER BY pos) AS s FROM (
    SELECT candidate_id, {d_norm('name')} AS nm, min(pos) AS pos FROM cand_skill
    WHERE {d_norm('name')} <> '' GROUP BY 1, 2) GROUP BY 1)""".replace("'@'", "' | '")


@query("p01_normalize_text", CAND + f"""
SELECT candidate_id, {d_norm('name')} AS name_text, {d_norm('headline')} AS headline_text,
  {d_norm('summary')} AS summary_text FROM cand""")
def p01(spark, sf):
    c = tb.candidates(spark, sf, ())
    return c.select("candidate_id", tx.norm_text("profile.anonymized_name").alias("name_text"),
                    tx.norm_text("profile.headline").alias("headline_text"),
                    tx.norm_text("profile.summary").alias("summary_text"))


@query("p02_normalize_raw", CAND + f"""
SELECT candidate_id, {d_raw('name')} AS name_raw, {d_raw('summary')} AS summary_raw FROM cand""")
def p02(spark, sf):
    c = tb.candidates(spark, sf, ())
    return c.select("candidate_id", tx.norm_raw("profile.anonymized_name").alias("name_raw"),
                    tx.norm_raw("profile.summary").alias("summary_raw"))


@query("p03_normalize_list", tb.with_flat("cand", "cand_job") + f"""
SELECT c.candidate_id, coalesce(x.s, '') AS companies FROM cand c LEFT JOIN (
  SELECT candidate_id, string_agg(nm, ' | ' ORDER BY pos) AS s FROM (
    SELECT candidate_id, {d_norm('company')} AS nm, min(pos) AS pos FROM cand_job GROUP BY 1, 2)
  GROUP BY 1) x USING (candidate_id)""")
def p03(spark, sf):
    c = tb.candidates(spark, sf, ("career_history",))
    return c.select("candidate_id", F.array_join(
        tx.norm_list(F.transform("career_history", lambda j: j["company"])), " | ").alias("companies"))


@query("p04_location", CAND + f"""
SELECT candidate_id, {d_raw("concat_ws(', ', nullif(location, ''), nullif(country, ''))")} AS location FROM cand""")
def p04(spark, sf):
    return tb.candidates(spark, sf, ()).select("candidate_id", pf.location_expr().alias("location"))


@query("p05_normalized_skills_titles", tb.with_flat("cand", "cand_skill", "cand_job") + f"""
SELECT c.candidate_id, coalesce(k.s, '') AS normalized_skills, coalesce(t.s, '') AS normalized_titles
FROM cand c LEFT JOIN {D_NORM_SKILLS} k USING (candidate_id) LEFT JOIN (
  SELECT candidate_id, string_agg(nm, ' | ' ORDER BY pos) AS s FROM (
    SELECT candidate_id, {d_norm('title')} AS nm, min(pos) AS pos FROM cand_job
    WHERE {d_norm('title')} <> '' GROUP BY 1, 2) GROUP BY 1) t USING (candidate_id)""")
def p05(spark, sf):
    c = pf.build_profile(tb.candidates(spark, sf, ("skills", "career_history")))
    return c.select("candidate_id", F.array_join("normalized_skills", " | ").alias("normalized_skills"),
                    F.array_join("normalized_titles", " | ").alias("normalized_titles"))


@query("p06_work_history_text", JOB + f"""
SELECT c.candidate_id, coalesce(w.work_history_text, '') AS work_history_text
FROM cand c LEFT JOIN {D_WORK} w USING (candidate_id)""")
def p06(spark, sf):
    c = tb.candidates(spark, sf, ("career_history",))
    return pf.build_profile(c).select("candidate_id", "work_history_text")


@query("p07_skills_text", SKILL + f"""
SELECT c.candidate_id, replace(coalesce(k.s, ''), ' | ', ' ') AS skills_text
FROM cand c LEFT JOIN {D_NORM_SKILLS} k USING (candidate_id)""")
def p07(spark, sf):
    return pf.build_profile(tb.candidates(spark, sf, ("skills",))).select("candidate_id", "skills_text")


@query("p08_profile_text", CAND + f"SELECT candidate_id, {D_PROFILE} AS profile_text FROM cand")
def p08(spark, sf):
    return pf.build_profile(tb.candidates(spark, sf, ())).select("candidate_id", "profile_text")


@query("p09_career_text", JOB + f"""
SELECT c.candidate_id, {d_norm(f"{D_PROFILE} || ' ' || coalesce(w.work_history_text, '')")} AS career_text
FROM cand c LEFT JOIN {D_WORK} w USING (candidate_id)""")
def p09(spark, sf):
    c = tb.candidates(spark, sf, ("career_history",))
    return pf.build_profile(c).select("candidate_id", "career_text")


@query("p10_education_text", tb.with_flat("cand", "cand_edu") + f"""
SELECT c.candidate_id, coalesce({d_norm('e.s')}, '') AS education_text FROM cand c LEFT JOIN (
  SELECT candidate_id, string_agg(institution || ' ' || degree || ' ' || field || ' ' || tier, ' ' ORDER BY pos) AS s
  FROM cand_edu GROUP BY 1) e USING (candidate_id)""")
def p10(spark, sf):
    return pf.build_profile(tb.candidates(spark, sf, ("education",))).select("candidate_id", "education_text")


@query("p11_sparse_text", tb.with_flat("cand", "cand_skill", "cand_job", "cand_edu") + f"""
SELECT c.candidate_id, {d_norm("concat_ws(' ', headline, summary, title, company, k.s, j.s, e.s)")} AS sparse_text
FROM cand c
LEFT JOIN (SELECT candidate_id, string_agg(name, ' ' ORDER BY pos) AS s FROM cand_skill GROUP BY 1) k USING (candidate_id)
LEFT JOIN (SELECT candidate_id, string_agg({_job_text}, ' ' ORDER BY pos) AS s FROM cand_job GROUP BY 1) j USING (candidate_id)
LEFT JOIN (SELECT candidate_id, string_agg(degree || ' ' || field || ' ' || institution, ' ' ORDER BY pos) AS s
           FROM cand_edu GROUP BY 1) e USING (candidate_id)""")
def p11(spark, sf):
    c = tb.candidates(spark, sf, ("skills", "career_history", "education"))
    return c.select("candidate_id", pf.sparse_text().alias("sparse_text"))


@query("p12_dense_text", SKILL + f"""
SELECT c.candidate_id, {d_norm("concat_ws(' ', headline, title, company, k.s)")} AS dense_text
FROM cand c LEFT JOIN (SELECT candidate_id, string_agg(name, ' ' ORDER BY pos) AS s FROM cand_skill
  WHERE pos <= 25 GROUP BY 1) k USING (candidate_id)""")
def p12(spark, sf):
    c = tb.candidates(spark, sf, ("skills",))
    return c.select("candidate_id", pf.dense_text().alias("dense_text"))


# Accented letters are word characters; RE2 boundaries are ASCII, so they become '_' first.
def d_term_tokens(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({c}), '[À-ÖØ-öø-ÿ]', '_', 'g'), '\b[a-z0-9./-]+\b')"


D_BM25_TEXT = ("concat_ws(' ', " + ", ".join(d_raw(x) for x in ["title", "headline", "summary"]) + ", coalesce(k.s, ''))")


@query("p13_bm25_tokens", SKILL + f"""
SELECT c.candidate_id, array_to_string({d_term_tokens(D_BM25_TEXT)}, ' ') AS tokens,
  CAST(len({d_term_tokens(D_BM25_TEXT)}) AS BIGINT) AS n_tokens
FROM cand c LEFT JOIN (SELECT candidate_id, string_agg(name, ' ' ORDER BY pos) AS s FROM cand_skill
  GROUP BY 1) k USING (candidate_id)""")
def p13(spark, sf):
    c = tb.candidates(spark, sf, ("skills",)).select("candidate_id", pf.bm25_tokens().alias("t"))
    return c.select("candidate_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query("p14_query_text", tb.with_flat("job", "job_line") + """
SELECT j.job_id, lower(concat_ws(' ', j.title, j.summary,
  string_agg(l.line, ' ' ORDER BY l.idx))) AS query_text
FROM job j JOIN job_line l USING (job_id) GROUP BY j.job_id, j.title, j.summary""")
def p14(spark, sf):
    return tb.jobs(spark, sf).select("job_id", pf.query_text().alias("query_text"))


@query("p15_recent_roles", JOB + f"""
SELECT c.candidate_id, concat_ws(' | ', {d_raw('c.title')}, j.s) AS recent_roles FROM cand c LEFT JOIN (
  SELECT candidate_id, string_agg(title, ' | ' ORDER BY pos) AS s FROM cand_job
  WHERE pos <= 2 AND title <> '' GROUP BY 1) j USING (candidate_id)""")
def p15(spark, sf):
    c = tb.candidates(spark, sf, ("career_history",))
    return c.select("candidate_id", F.array_join(pf.recent_roles(), " | ").alias("recent_roles"))


@query("p16_lifted_signals", CAND + "SELECT candidate_id, notice_days AS notice_period_days, open_to_work FROM cand")
def p16(spark, sf):
    c = pf.build_profile(tb.candidates(spark, sf, ()))
    return c.select("candidate_id", F.col("notice_period_days").cast("long").alias("notice_period_days"), "open_to_work")


@query("p17_dataset_stats", tb.with_flat("cand", "cand_skill", "cand_job") + rf"""
SELECT count(*) AS total_candidates, round(avg(coalesce(k.n, 0)), 2) AS average_skills,
  round(avg(years), 2) AS average_experience,
  CAST(sum(CASE WHEN {d_strip('summary')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_summaries,
  CAST(sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_skills,
  CAST(sum(CASE WHEN j.n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_work_history,
  CAST(0 AS BIGINT) AS malformed_candidates
FROM cand LEFT JOIN (SELECT candidate_id, count(*) AS n FROM cand_skill GROUP BY 1) k USING (candidate_id)
LEFT JOIN (SELECT candidate_id, count(*) AS n FROM cand_job GROUP BY 1) j USING (candidate_id)""")
def p17(spark, sf):
    return pf.dataset_stats(tb.candidates(spark, sf, ("skills", "career_history")))
