"""M01-M20."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions import fixed_values as fv
from candisieve.functions.topk import join_shares, key_shares, with_share
from candisieve.operators import skills as sk
from candisieve.operators.profile import build_profile
from candisieve.session import materialize, scratch_path
from candisieve.sources.synonyms import parse_synonyms
from candisieve.streaming.cohort import keep_counts, kept_rarity
from workloads import testbed as tb
from workloads.registry import d_list, d_map_case, query
from workloads.skill_sql import (
    CERT_OF, CLASSIFIED_SQL, D_CERT_SIGNAL, D_RARITY, FLAT_JOB, JOB_SQL, LADDER_SQL, d_bound, d_escape,
)

SYNONYMS = {
    "sentence transformers": "sentence-transformers", "recommender systems": "recommendation systems",
    "recommendation engine": "recommendation systems", "retrieval augmented generation": "RAG",
}
SYNONYM_JSON = (
    '{"sentence transformers": "sentence-transformers", "recommender systems": "recommendation systems", '
    '"recommendation engine": "recommendation systems", "retrieval augmented generation": "RAG"}')


def synonyms(spark):
    return parse_synonyms(spark.createDataFrame([(SYNONYM_JSON,)], "value string"))


def d_clean(c: str) -> str:
    return rf"lower(trim(regexp_replace(replace({c}, '-', ' '), '\s+', ' ', 'g')))"


_CLEANED = {k: v.replace("-", " ").lower() for k, v in SYNONYMS.items()}


def d_synonym(c: str) -> str:
    return d_map_case(d_clean(c), _CLEANED)


def d_word_match(skill: str, req: str) -> str:
    return rf"""(CASE WHEN {skill} = '' THEN false WHEN contains({skill}, ' ') THEN contains({req}, {skill})
      ELSE regexp_matches({req}, CASE WHEN regexp_matches({skill}, '^[a-z0-9]') THEN '\b' ELSE '' END || {d_escape(skill)}
        || CASE WHEN regexp_matches({skill}, '[a-z0-9]$') THEN '\b' ELSE '' END) END)"""


# Distinct names meet once; applicants then join on names.
D_ANALYSIS = tb.with_flat("job", "job_line", "cand_skill", "cand_cert", "application").rstrip() + f""",
req AS (SELECT job_id, kind, norm, min(idx) AS idx FROM (SELECT job_id, kind, idx, {d_synonym('line')} AS norm FROM job_line) x WHERE norm <> '' GROUP BY 1, 2, 3),
sks AS (SELECT DISTINCT candidate_id, {d_synonym('name')} AS norm, {d_clean('name')} AS clean FROM cand_skill),
crt AS (SELECT DISTINCT candidate_id, {d_clean('name')} AS norm FROM cand_cert),
rn AS (SELECT DISTINCT norm, regexp_matches(norm, {D_CERT_SIGNAL}) AS is_cert FROM req),
sn AS (SELECT DISTINCT norm, clean FROM sks),
pair AS (SELECT r.norm AS r_norm, s.norm AS s_norm, s.clean, {d_word_match('s.clean', 'r.norm')} AS exact
  FROM rn r CROSS JOIN sn s WHERE NOT r.is_cert AND {d_word_match('s.norm', 'r.norm')}),
line_hit AS (SELECT a.job_id, a.candidate_id, r.kind, r.idx, r.norm AS r_norm, s.norm, bool_or(p.exact) AS exact
  FROM application a JOIN req r USING (job_id) JOIN pair p ON p.r_norm = r.norm
  JOIN sks s ON s.candidate_id = a.candidate_id AND s.norm = p.s_norm AND s.clean = p.clean GROUP BY ALL),
cert_hit AS (SELECT DISTINCT a.job_id, a.candidate_id, c.norm FROM application a JOIN req r USING (job_id) JOIN rn ON rn.norm = r.norm AND rn.is_cert
  JOIN crt c ON c.candidate_id = a.candidate_id AND {d_map_case('c.norm', CERT_OF)} = {d_map_case('r.norm', CERT_OF)}),
exact AS (SELECT DISTINCT job_id, candidate_id, norm FROM line_hit WHERE exact UNION SELECT * FROM cert_hit),
synonym AS (SELECT DISTINCT job_id, candidate_id, norm FROM line_hit h WHERE NOT exact AND (kind = 'required' OR NOT EXISTS (
  SELECT 1 FROM line_hit e WHERE e.exact AND e.job_id = h.job_id AND e.candidate_id = h.candidate_id AND e.norm = h.norm
    AND (e.kind = 'required' OR e.idx < h.idx)))),
matched AS (SELECT * FROM exact UNION SELECT * FROM synonym),
lost AS (SELECT a.job_id, a.candidate_id, r.kind, r.norm FROM application a JOIN req r USING (job_id) JOIN rn ON rn.norm = r.norm
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.job_id = a.job_id AND m.candidate_id = a.candidate_id AND
    CASE WHEN rn.is_cert THEN {d_map_case('m.norm', CERT_OF)} = {d_map_case('r.norm', CERT_OF)} ELSE {d_word_match('m.norm', 'r.norm')} END))
"""


def beside_job(spark, sf, cand, job):
    """Applicants beside their job. A job with many applicants meets them in shares.

    The ids meet the job first: a candidate is the larger row and stays where its parts were joined.
    """
    apps = tb.applications(spark, sf)
    shares = key_shares(apps, "job_id")
    return join_shares(with_share(apps, shares, "job_id", "candidate_id"), job, shares, "job_id").join(cand, "candidate_id")


def pairs_for_analysis(spark, sf):
    cand = tb.candidates(spark, sf, ("skills", "certifications")).select("candidate_id", "skills", "certifications")
    job = tb.jobs(spark, sf).select("job_id", "requirements", "preferred_skills")
    return beside_job(spark, sf, cand, job)


def prepared_pairs(spark, sf):
    """Applicants beside their job, both prepared for the ladder."""
    profile = build_profile(tb.candidates(spark, sf, ("skills", "certifications", "career_history")))
    cand = sk.prepare_candidates(profile).select(
        "candidate_id", "skill_units", "cert_units", "title_texts", "career_lower")
    job = sk.prepare_jobs(tb.jobs(spark, sf)).select("job_id", "units", "atomic", "critical")
    return beside_job(spark, sf, cand, job)


@query("m01_normalize_skill", tb.with_flat("cand_skill") + f"""
SELECT candidate_id, pos, {d_clean('name')} AS cleaned, {d_synonym('name')} AS normalized FROM cand_skill""")
def m01(spark, sf):
    from candisieve.functions.text import clean_skill
    from candisieve.sources.synonyms import synonym_map
    s = tb.flat(spark, sf, "cand_skill").withColumn("_syn", synonym_map(synonyms(spark)))
    return s.select("candidate_id", "pos", clean_skill("name").alias("cleaned"),
                    sk.normalize_skill(F.col("name"), F.col("_syn")).alias("normalized"))


@query("m02_text_match", tb.with_flat("job_line", "cand_skill", "application").rstrip() + f""",
rn AS (SELECT DISTINCT {d_clean('line')} AS r FROM job_line), sn AS (SELECT DISTINCT {d_clean('name')} AS s FROM cand_skill),
m AS (SELECT r, s FROM rn CROSS JOIN sn WHERE NOT regexp_matches(r, {D_CERT_SIGNAL}) AND {d_word_match('s', 'r')})
SELECT DISTINCT a.job_id, a.candidate_id, m.r AS requirement, m.s AS skill FROM application a JOIN job_line l USING (job_id)
JOIN cand_skill k USING (candidate_id) JOIN m ON m.r = {d_clean('l.line')} AND m.s = {d_clean('k.name')}""")
def m02(spark, sf):
    from candisieve.functions.text import clean_skill, mark_bounds, mark_word
    def distinct_clean(c):
        return F.array_distinct(F.transform(c, clean_skill))
    rows = pairs_for_analysis(spark, sf).select(
        "job_id", "candidate_id",
        F.transform(distinct_clean(F.transform("skills", lambda s: s["name"])), lambda s: F.struct(
            s.alias("name"), mark_word(s).alias("m"))).alias("skills"), "requirements", "preferred_skills")
    rows = rows.withColumn("requirement", F.explode(distinct_clean(F.concat("requirements", "preferred_skills"))))
    rows = rows.filter(~sk.is_cert_text(F.col("requirement"))).withColumn("mark", mark_bounds("requirement"))
    hits = F.filter("skills", lambda s: sk.text_match(s["name"], F.col("requirement"), F.lit(False), F.col("mark"), s["m"]))
    return rows.select("job_id", "candidate_id", "requirement", F.explode(hits).alias("h")).select(
        "job_id", "candidate_id", "requirement", F.col("h.name").alias("skill"))


def _analysis(spark, sf, *fields):
    out = sk.skill_matches(pairs_for_analysis(spark, sf), synonyms(spark))
    return out.select("job_id", "candidate_id", *[
        F.array_join(f"skill_analysis.{f}", " | ").alias(f) for f in fields])


def _d_list_of(table: str, where: str = "true") -> str:
    return f"(SELECT job_id, candidate_id, string_agg(norm, ' | ' ORDER BY norm) AS s FROM {table} WHERE {where} GROUP BY 1, 2)"


@query("m03_skill_matches", D_ANALYSIS + f"""SELECT a.job_id, a.candidate_id, coalesce(e.s, '') AS exact_matches, coalesce(y.s, '') AS synonym_matches
FROM application a LEFT JOIN {_d_list_of('exact')} e USING (job_id, candidate_id) LEFT JOIN {_d_list_of('synonym')} y USING (job_id, candidate_id)""")
def m03(spark, sf):
    return _analysis(spark, sf, "exact_matches", "synonym_matches")


@query("m04_missing_skills", D_ANALYSIS + f"""SELECT a.job_id, a.candidate_id, coalesce(r.s, '') AS missing_required_skills, coalesce(p.s, '') AS missing_preferred_skills
FROM application a LEFT JOIN {_d_list_of('lost', "kind = 'required'")} r USING (job_id, candidate_id)
LEFT JOIN {_d_list_of('lost', "kind = 'preferred'")} p USING (job_id, candidate_id)""")
def m04(spark, sf):
    return _analysis(spark, sf, "missing_required_skills", "missing_preferred_skills")


@query("m05_additional_skills", D_ANALYSIS + """, mine AS (SELECT candidate_id, norm FROM sks UNION SELECT * FROM crt),
extra AS (SELECT a.job_id, a.candidate_id, m.norm FROM application a JOIN mine m USING (candidate_id)
  WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.job_id = a.job_id AND r.norm = m.norm))
SELECT a.job_id, a.candidate_id, coalesce(x.s, '') AS additional_candidate_skills FROM application a
LEFT JOIN """ + _d_list_of("extra") + " x USING (job_id, candidate_id)")
def m05(spark, sf):
    return _analysis(spark, sf, "additional_candidate_skills")


_RUNG_FROM = """ FROM own_facts f"""


def _rung_check(cls: str, skill: str, where: str, measure: str = "CAST(NULL AS DOUBLE)") -> str:
    return LADDER_SQL + f"""SELECT w.job_id, f.candidate_id, CAST(w.idx AS BIGINT) AS req_idx, {cls} AS cls, {skill} AS skill, {measure} AS measure
FROM weights w JOIN facts f ON f.job_id = w.job_id AND f.norm = w.norm WHERE {where}"""


def _d_skill(pos: str) -> str:
    return f"(SELECT name FROM sk WHERE sk.candidate_id = f.candidate_id AND sk.pos = {pos})"


_BROAD = d_list(fv.BROAD_TERMS)
RUNG_CHECKS = {
    "m06_rung_certification": (sk.rung_cert, _rung_check(
        "CASE WHEN f.cert_name IS NULL THEN 'NONE' ELSE 'DIRECT' END", "f.cert_name", "f.is_cert")),
    "m07_rung_direct": (sk.rung_direct, _rung_check("'DIRECT'", _d_skill("f.a_pos"), "f.a_pos IS NOT NULL")),
    "m08_rung_family_skill": (sk.rung_family, _rung_check("'DIRECT'", _d_skill("f.b_pos"), "f.b_pos IS NOT NULL")),
    "m08_rung_family_text": (sk.rung_family_text, _rung_check("'SUPPORTED'", "CAST(NULL AS VARCHAR)", "f.family_in_text")),
    "m09_rung_title": (sk.rung_title, _rung_check(
        "CASE WHEN f.eq_pos IS NOT NULL OR f.sup_pos IS NOT NULL OR f.eq_in_text THEN 'EQUIVALENT' ELSE 'SUPPORTED' END",
        "CAST(NULL AS VARCHAR)", "f.claimed")),
    "m10_rung_domain": (sk.rung_domain, _rung_check(
        "CASE WHEN f.eq_pos IS NOT NULL THEN 'EQUIVALENT' ELSE 'SUPPORTED' END",
        _d_skill("coalesce(f.eq_pos, f.sup_pos)"), "coalesce(f.eq_pos, f.sup_pos) IS NOT NULL")),
    "m11_rung_competitor": (sk.rung_competitor, _rung_check(
        "CASE WHEN f.in_text THEN 'SUPPORTED' ELSE 'RELATED' END",
        f"CASE WHEN f.in_text THEN {_d_skill('f.f_pos')} END", "f.f_pos IS NOT NULL")),
    "m12_rung_composite": (sk.rung_composite, _rung_check(
        "'EQUIVALENT'", _d_skill("f.g_pos"), "f.cover >= 0.60", "f.cover")),
    "m13_rung_similarity": (sk.rung_similarity, _rung_check(
        f"CASE WHEN f.h_norm IN {_BROAD} THEN 'RELATED' WHEN f.in_text THEN 'SUPPORTED' ELSE 'RELATED' END",
        f"CASE WHEN f.h_norm NOT IN {_BROAD} AND f.in_text THEN {_d_skill('f.h_pos')} END",
        f"f.h_sim > 0 AND (f.h_sim >= 0.70 OR f.h_norm IN {_BROAD})", "f.h_sim")),
    "m13_rung_text": (sk.rung_text, _rung_check("'SUPPORTED'", "CAST(NULL AS VARCHAR)", "f.in_text")),
}


def _register_rung(name, rung, check):
    @query(name, check)
    def run(spark, sf):
        return sk.explain_rung(prepared_pairs(spark, sf), rung)


for _name, (_rung, _check) in RUNG_CHECKS.items():
    _register_rung(_name, _rung, _check)


def classified_rows(spark, sf):
    return sk.classify(prepared_pairs(spark, sf)).select("job_id", "candidate_id", F.explode("classified").alias("c"))


@query("m13_skill_ladder", LADDER_SQL + """SELECT w.job_id, h.candidate_id, CAST(w.idx AS BIGINT) AS req_idx, h.cls, h.rung, h.skill, h.measure
FROM weights w JOIN hit h ON h.job_id = w.job_id AND h.norm = w.norm""")
def m13(spark, sf):
    hits = F.transform("units", lambda x: F.struct(x["idx"].alias("idx"), sk.ladder(x["unit"]).alias("h")))
    return prepared_pairs(spark, sf).select("job_id", "candidate_id", F.explode(hits).alias("x")).select(
        "job_id", "candidate_id", F.col("x.idx").alias("req_idx"), "x.h.cls", "x.h.rung",
        F.col("x.h.skill.name").alias("skill"), "x.h.measure")


@query("m15_constituents", JOB_SQL + """SELECT job_id, CAST(idx AS BIGINT) AS req_idx, string_agg(part, ' | ' ORDER BY part_pos) AS constituents
FROM part GROUP BY 1, 2""")
def m15(spark, sf):
    job = sk.prepare_jobs(tb.jobs(spark, sf)).select("job_id", F.explode("units").alias("u"))
    return job.filter(F.size("u.parts") > 0).select("job_id", F.col("u.idx").alias("req_idx"), F.array_join(
        F.transform("u.parts", lambda p: p["text"]), " | ").alias("constituents"))


@query("m16_constituent_upgrade", CLASSIFIED_SQL + """SELECT job_id, candidate_id, CAST(idx AS BIGINT) AS req_idx, cls, rung, skill, via FROM classified""")
def m16(spark, sf):
    return classified_rows(spark, sf).select(
        "job_id", "candidate_id", F.col("c.idx").alias("req_idx"), "c.cls", "c.rung", F.col("c.skill.name").alias("skill"), "c.via")


@query("m17_ontology_terms", JOB_SQL + """SELECT l.job_id, CAST(l.idx AS BIGINT) AS req_idx, string_agg(t.term, ' | ' ORDER BY t.term) AS terms
FROM job_line l JOIN line_term t USING (line) GROUP BY 1, 2""")
def m17(spark, sf):
    lines = tb.flat(spark, sf, "job_line").select("job_id", F.col("idx").alias("req_idx"), F.array_join(
        sk.ontology_terms_in_text(F.col("line")), " | ").alias("terms"))
    return lines.filter("terms <> ''")


@query("m18_critical_skills", JOB_SQL + """SELECT j.job_id, EXISTS (SELECT 1 FROM critical c WHERE c.job_id = j.job_id) AS atomic,
  coalesce((SELECT string_agg(term, ' | ' ORDER BY term) FROM critical c WHERE c.job_id = j.job_id),
    (SELECT string_agg(line, ' | ' ORDER BY idx) FROM job_line l WHERE l.job_id = j.job_id AND l.idx < 2)) AS critical FROM job j""")
def m18(spark, sf):
    return sk.prepare_jobs(tb.jobs(spark, sf)).select("job_id", "atomic", F.array_join("critical", " | ").alias("critical"))


@query("m19_requirement_weights", JOB_SQL + "SELECT job_id, CAST(idx AS BIGINT) AS req_idx, line AS requirement, weight, is_critical FROM weights")
def m19(spark, sf):
    return sk.requirement_weights(sk.prepare_jobs(tb.jobs(spark, sf)))


D_M20 = tb.with_flat("cand_skill", "application").rstrip() + f", {D_RARITY} SELECT job_id, skill, round(rarity, 6) AS rarity FROM rarity"


def _cohort(spark, sf):
    return tb.applications(spark, sf).join(tb.candidates(spark, sf, ("skills",)).select("candidate_id", "skills"), "candidate_id")


@query("m20_skill_rarity", D_M20)
def m20(spark, sf):
    return sk.skill_rarity(_cohort(spark, sf)).withColumn("rarity", F.round("rarity", 6))


@query("m20_rarity_kept", D_M20)
def m20_kept(spark, sf):
    """The same applications as they arrive: a stream over files, in about four batches."""
    arrived = materialize(_cohort(spark, sf).select("job_id", "skills"), "applications")
    files = arrived.inputFiles()
    stream = (spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", -(-len(files) // 4))
              .parquet(files[0].rsplit("/", 1)[0]))
    store = scratch_path(spark, "rarity")
    keep_counts(stream, store, scratch_path(spark, "rarity-state")).awaitTermination()
    return kept_rarity(spark, store).withColumn("rarity", F.round("rarity", 6))
