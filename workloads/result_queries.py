"""M14, M21, E01-E10, V01-V06, N01-N14, X01-X06 over stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.operators import analytics as na
from candisieve.operators import explain as ex
from candisieve.operators import explore as xp
from candisieve.operators import search_index as sx
from candisieve.operators import quality as qa
from candisieve.operators.profile import build_profile
from candisieve.operators.skills import match_lists, requirement_coverage
from candisieve.session import discard, materialize, scratch_path
from workloads import testbed as tb
from workloads.registry import d_raw, query
from workloads.skill_sql import d_bound

RES = tb.d_results()
KEYS = ["job_id", "candidate_id"]


def d_agg(list_names: str, col: str = "clean", sep: str = " | ") -> str:
    return f"(SELECT string_agg({col}, '{sep}' ORDER BY list, idx) FROM entry e WHERE e.job_id = r.job_id AND e.candidate_id = r.candidate_id AND e.list IN ({list_names}))"


# ------------------------------------------------------------------ M14, M21

@query("m14_match_lists", RES + """, analysed AS (SELECT job_id, candidate_id, list, idx, lower(line) AS name FROM entry),
tier AS (SELECT job_id, candidate_id, idx + CASE list WHEN 'critical_skills_matched' THEN 0 WHEN 'important_skills_matched' THEN 100 ELSE 200 END AS o, line
  FROM entry WHERE list IN ('critical_skills_matched', 'important_skills_matched', 'nice_to_have_skills_matched')),
got AS (SELECT job_id, candidate_id, name, min(idx) AS o FROM analysed WHERE list = 'matched_skills' GROUP BY 1, 2, 3),
matched AS (SELECT * FROM got UNION ALL SELECT job_id, candidate_id, line, min(o) FROM tier t
  WHERE NOT EXISTS (SELECT 1 FROM got g WHERE g.job_id = t.job_id AND g.candidate_id = t.candidate_id) GROUP BY 1, 2, 3),
known AS (SELECT job_id, candidate_id, lower(trim(line)) AS k FROM tier UNION SELECT job_id, candidate_id, lower(trim(name)) FROM matched),
lost AS (SELECT job_id, candidate_id, name, min(idx) AS o FROM analysed WHERE list = 'missing_skills' GROUP BY 1, 2, 3),
missing AS (SELECT * FROM lost UNION ALL SELECT job_id, candidate_id, line, idx FROM entry t WHERE list = 'missing_critical_skills'
  AND NOT EXISTS (SELECT 1 FROM lost g WHERE g.job_id = t.job_id AND g.candidate_id = t.candidate_id))
SELECT r.job_id, r.candidate_id,
  coalesce((SELECT string_agg(name, ' | ' ORDER BY o) FROM matched m WHERE m.job_id = r.job_id AND m.candidate_id = r.candidate_id), '') AS matched,
  coalesce((SELECT string_agg(name, ' | ' ORDER BY o) FROM missing m WHERE m.job_id = r.job_id AND m.candidate_id = r.candidate_id
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.job_id = m.job_id AND k.candidate_id = m.candidate_id AND k.k = lower(trim(m.name)))), '') AS missing
FROM result r""")
def m14(spark, sf):
    low = lambda c: F.transform(c, F.lower)
    none = F.expr("cast(array() as array<string>)")
    rows = tb.results(spark, sf, profile=False).withColumn("skill_analysis", F.struct(
        low("matched_skills").alias("exact_matches"), none.alias("synonym_matches"),
        low("missing_skills").alias("missing_required_skills"), none.alias("missing_preferred_skills")))
    matched, missing = match_lists()
    return rows.select(*KEYS, F.array_join(matched, " | ").alias("matched"), F.array_join(missing, " | ").alias("missing"))


@query("m21_requirement_coverage", RES + f""", got AS (SELECT DISTINCT job_id, candidate_id, lower(clean) AS m FROM entry WHERE list NOT LIKE 'missing%'),
lost AS (SELECT DISTINCT job_id, candidate_id, lower(clean) AS m FROM entry WHERE list LIKE 'missing%'),
wanted AS (SELECT r.job_id, r.candidate_id, l.idx - CASE WHEN l.kind = 'required' THEN 0 ELSE 4 END AS pos, trim(l.line) AS name, l.kind = 'required' AS required FROM result r JOIN job_line l ON l.job_id = r.job_id
  WHERE l.kind = 'required' OR lower(trim(l.line)) <> 'none specified'),
facts AS (SELECT w.job_id, w.candidate_id, w.pos, w.name, w.required, coalesce(bool_or(length(g.m) >= 2 AND {d_bound('g.m', 'lower(w.name)')}), false) AS inside,
    coalesce(bool_or(contains(g.m, lower(w.name)) OR contains(lower(w.name), g.m)), false) AS loose
  FROM wanted w LEFT JOIN got g USING (job_id, candidate_id) GROUP BY ALL)
SELECT f.job_id, f.candidate_id, f.pos, f.name, f.required, inside OR (loose AND NOT EXISTS (
  SELECT 1 FROM lost l WHERE l.job_id = f.job_id AND l.candidate_id = f.candidate_id AND l.m = lower(f.name))) AS matched FROM facts f""")
def m21(spark, sf):
    return requirement_coverage(tb.results(spark, sf, profile=False))


# ------------------------------------------------------------------ explanations

D_OVERVIEW = """CASE WHEN trim(current_title) <> '' AND trim(current_company) <> '' THEN name || ' is currently a ' || trim(current_title) || ' at ' || trim(current_company) || ' with ' || printf('%.1f', years) || ' years of relevant experience.'
  WHEN trim(current_title) <> '' THEN name || ' brings ' || printf('%.1f', years) || ' years of professional experience, working as a ' || trim(current_title) || '.'
  ELSE name || ' has ' || printf('%.1f', years) || ' years of technical experience in this domain.' END"""
D_MATCHED = """matched_names AS (SELECT job_id, candidate_id, clean, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY o) AS n FROM (
  SELECT job_id, candidate_id, arg_min(clean, o) AS clean, min(o) AS o FROM (SELECT *, idx + CASE list WHEN 'critical_skills_matched' THEN 0 WHEN 'important_skills_matched' THEN 100 ELSE 200 END AS o
    FROM entry WHERE list IN ('critical_skills_matched', 'important_skills_matched', 'nice_to_have_skills_matched')) x GROUP BY job_id, candidate_id, lower(clean)) y)"""
D_STRENGTHS = """coalesce((SELECT 'Strengths: Direct evidence verified for ' || string_agg(clean, ', ' ORDER BY n) || '.' FROM matched_names m
  WHERE m.job_id = r.job_id AND m.candidate_id = r.candidate_id AND n <= 5), 'Strengths: General domain background with limited direct skill overlap.')"""
# Gap names: distinct critical ones first (none is written in lower case twice here), then lines.
D_GAP_NAMES = """gap_raw AS (SELECT job_id, candidate_id, idx AS o, clean AS g, 0 AS later FROM entry WHERE list = 'missing_critical_skills'
  UNION ALL SELECT r.job_id, r.candidate_id, 1000 + l.idx, trim(l.line), 1 FROM result r JOIN job_line l ON l.job_id = r.job_id WHERE l.kind = 'required' OR lower(l.line) <> 'none specified'),
gap_kept AS (SELECT * FROM gap_raw g WHERE CASE WHEN later = 0 THEN NOT EXISTS (SELECT 1 FROM gap_raw h WHERE h.job_id = g.job_id AND h.candidate_id = g.candidate_id AND h.later = 0 AND h.o < g.o AND h.g = lower(g.g))
  ELSE NOT EXISTS (SELECT 1 FROM matched_names m WHERE m.job_id = g.job_id AND m.candidate_id = g.candidate_id AND lower(m.clean) = lower(g.g))
    AND NOT EXISTS (SELECT 1 FROM gap_raw h WHERE h.job_id = g.job_id AND h.candidate_id = g.candidate_id AND h.o < g.o AND h.g = g.g) END),
gap_names AS (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY o) AS n FROM gap_kept)"""
D_GAPS = """coalesce((SELECT 'Gaps: Lacks documented skill evidence for ' || string_agg(g, ', ' ORDER BY n) || '.' FROM gap_names m
  WHERE m.job_id = r.job_id AND m.candidate_id = r.candidate_id AND n <= 4), 'Gaps: Complete skill requirement coverage confirmed.')"""
D_RISKS = """CASE WHEN is_honeypot OR notice_days > 60 THEN 'Risks: ' || concat_ws(', ', CASE WHEN is_honeypot THEN 'flagged for career timeline discrepancies' END,
  CASE WHEN notice_days > 60 THEN notice_days || '-day notice period requirement' END) || '.' ELSE 'Risks: No timeline anomalies or availability flags.' END"""
D_ADVICE = """CASE WHEN final_score >= 80 THEN 'Recommendation: Strong candidate for the ' || job_title || ' position based on core requirement coverage.'
  WHEN final_score >= 60 THEN 'Recommendation: Recommended for preliminary interview to verify specific skill depth.'
  ELSE 'Recommendation: Lower priority review due to key skill gaps against job requirements.' END"""
EXPLAIN = f"{RES}, {D_MATCHED}, {D_GAP_NAMES}\n"


def _explained(name, alias, column, check):
    @query(name, EXPLAIN + f"SELECT r.job_id, r.candidate_id, {check} AS {alias} FROM res r")
    def run(spark, sf):
        return tb.results(spark, sf).select(*KEYS, column().alias(alias))


_explained("e01_overview", "overview", ex.overview, D_OVERVIEW)
_explained("e02_strengths", "strengths", ex.strengths, D_STRENGTHS)
_explained("e03_gaps", "gaps", ex.gaps, D_GAPS)
_explained("e04_risks", "risks", ex.risks, D_RISKS)
_explained("e05_recommendation", "recommendation", ex.recommendation, D_ADVICE)


# Every second evaluation is missing.
D_NONE_STRENGTHS = "'Strengths: General domain background with limited direct skill overlap.'"
D_NONE_GAPS = """(SELECT 'Gaps: Lacks documented skill evidence for ' || string_agg(g, ', ' ORDER BY o) || '.' FROM (
  SELECT trim(line) AS g, min(idx) AS o, row_number() OVER (ORDER BY min(idx)) AS n FROM job_line l WHERE l.job_id = r.job_id AND (l.kind = 'required' OR lower(l.line) <> 'none specified') GROUP BY 1) x WHERE n <= 4)"""
D_NONE_RISKS = D_RISKS.replace("is_honeypot", "false")


@query("e06_explain_cohort", EXPLAIN + f"""SELECT r.job_id, r.candidate_id, CASE WHEN r.rank % 2 = 0 THEN concat_ws(' ', {D_OVERVIEW}, {D_STRENGTHS}, {D_GAPS}, {D_RISKS}, {D_ADVICE})
ELSE concat_ws(' ', {D_OVERVIEW}, {D_NONE_STRENGTHS}, {D_NONE_GAPS}, {D_NONE_RISKS}, 'Recommendation: Lower priority review due to key skill gaps against job requirements.') END AS reasoning FROM res r""")
def e06(spark, sf):
    rows = tb.results(spark, sf, profile=False)
    profile = build_profile(tb.candidates(spark, sf, ())).withColumn("notice_period_days", F.col("notice_period_days").cast("long"))
    return ex.explain(rows.select(*KEYS), profile, tb.jobs(spark, sf), rows.filter("rank % 2 = 0"))


@query("e07_advice", RES + """SELECT job_id, candidate_id, CASE WHEN is_honeypot THEN 'Do Not Interview' WHEN final_score >= 80 THEN 'Strong Candidate - Highly Recommended'
  WHEN final_score >= 60 THEN 'Recommended for Preliminary Screening' ELSE 'Review Qualifications' END AS action FROM res""")
def e07(spark, sf):
    return tb.results(spark, sf).select(*KEYS, ex.advice_action().alias("action"))


@query("e08_badges", RES + """SELECT job_id, candidate_id, coalesce(nullif(concat_ws(' | ', CASE WHEN skill_score >= 20 OR final_score >= 60 THEN 'Strong Skill Match' END,
  CASE WHEN experience_score >= 10 OR years >= 3 THEN 'Relevant Experience' END, CASE WHEN open_to_work THEN 'Open to Work' END, CASE WHEN NOT is_honeypot THEN 'Verified Timeline' END,
  CASE WHEN years >= 8 THEN 'Domain Experience' END, CASE WHEN response_rate >= 0.8 THEN 'High Recruiter Response' END), ''), 'Strong Profile') AS badges FROM res""")
def e08(spark, sf):
    return tb.results(spark, sf).select(*KEYS, F.array_join(ex.badges(), " | ").alias("badges"))


@query("e09_concise_summary", RES + f"""SELECT job_id, candidate_id, coalesce(nullif(current_title, ''), 'Candidate') || coalesce(' at ' || nullif(current_company, ''), '')
  || ' with ' || printf('%.1f', years) || ' years of experience.' || coalesce(' Strong evidence for ' || {d_agg("'matched_skills'", sep=', ')} || '.', '')
  || coalesce(' Documented gaps include ' || {d_agg("'missing_skills'", sep=', ')} || '.', ' No major critical skill gaps identified.')
  || CASE WHEN open_to_work THEN ' Open to Work with a ' || notice_days || '-day notice period.' ELSE '' END AS summary FROM res r""")
def e09(spark, sf):
    return tb.results(spark, sf).select(*KEYS, ex.concise_summary().alias("summary"))


@query("e10_strength_gap_lists", RES + f""", known AS (SELECT DISTINCT job_id, candidate_id, lower(clean) AS m FROM entry WHERE list NOT LIKE 'missing%'),
open_gap AS (SELECT e.job_id, e.candidate_id, e.idx, e.clean FROM entry e WHERE list = 'missing_skills' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.job_id = e.job_id AND k.candidate_id = e.candidate_id
  AND (k.m = lower(e.clean) OR (length(k.m) >= 2 AND {d_bound('k.m', 'lower(e.clean)')}))))
SELECT r.job_id, r.candidate_id, concat_ws(' | ', coalesce((SELECT string_agg('Verified coverage: ' || clean, ' | ' ORDER BY idx) FROM entry e WHERE e.job_id = r.job_id AND e.candidate_id = r.candidate_id AND list = 'matched_skills'),
    'General technical domain background.'), CASE WHEN NOT is_honeypot THEN 'Timeline integrity clear: no duration anomalies.' END, CASE WHEN open_to_work THEN 'Actively seeking opportunities (Open to Work).' END) AS strengths,
  concat_ws(' | ', CASE WHEN is_honeypot THEN 'Chronological anomalies detected in career history duration records.' END,
    (SELECT string_agg('Lacks documented evidence for: ' || clean, ' | ' ORDER BY idx) FROM open_gap g WHERE g.job_id = r.job_id AND g.candidate_id = r.candidate_id),
    CASE WHEN notice_days >= 60 THEN 'Long notice period requirement (' || notice_days || ' days).' END) AS gaps FROM res r""")
def e10(spark, sf):
    return tb.results(spark, sf).select(*KEYS, F.array_join(ex.strength_list(), " | ").alias("strengths"),
                                        F.array_join(ex.gap_list(), " | ").alias("gaps"))


# ------------------------------------------------------------------ checks of a list as handed in

HANDED = tb.with_flat("handed_in").rstrip() + r""", whole AS (SELECT job_id, row_num, trim(candidate_id) AS id, trim(rank) AS rank_text, trim(score) AS score_text,
    CASE WHEN regexp_matches(trim(rank), '^(0|-?[1-9][0-9]*)$') THEN CAST(trim(rank) AS BIGINT) END AS r, try_cast(trim(score) AS DOUBLE) AS s FROM handed_in WHERE n_cells = 4),
seq AS (SELECT *, lead(s) OVER w AS next_s, lead(id) OVER w AS next_id FROM whole WHERE r IS NOT NULL AND s IS NOT NULL AND id <> '' WINDOW w AS (PARTITION BY job_id ORDER BY r, row_num))
"""


def _v(rule: str, key: str, source: str, where: str) -> str:
    return f"SELECT job_id, '{rule}' AS rule, CAST({key} AS VARCHAR) AS row_key FROM {source} WHERE {where}"


V_SQL = {
    "v01_shape": [_v("row_count", "n", "(SELECT job_id, count(*) AS n FROM handed_in GROUP BY 1) c", "n <> 100"), _v("cell_count", "row_num", "handed_in", "n_cells <> 4")],
    "v02_ids": [_v("id_missing", "row_num", "whole", "id = ''"), _v("id_pattern", "row_num", "whole", "id <> '' AND NOT regexp_matches(id, '^CAND_[0-9]{7}$')"),
                _v("id_duplicate", "row_num", "(SELECT *, row_number() OVER (PARTITION BY job_id, id ORDER BY row_num) AS n FROM whole WHERE regexp_matches(id, '^CAND_[0-9]{7}$')) d", "n > 1")],
    "v03_ranks": [_v("rank_integer", "row_num", "whole", "r IS NULL"), _v("rank_range", "row_num", "whole", "r NOT BETWEEN 1 AND 100"),
                  _v("rank_duplicate", "row_num", "(SELECT *, row_number() OVER (PARTITION BY job_id, r ORDER BY row_num) AS n FROM whole WHERE r BETWEEN 1 AND 100) d", "n > 1"),
                  _v("rank_missing", "i", "(SELECT j.job_id, i FROM (SELECT DISTINCT job_id FROM handed_in) j CROSS JOIN (SELECT unnest(generate_series(1, 100)) AS i) g) m",
                     "NOT EXISTS (SELECT 1 FROM whole w WHERE w.job_id = m.job_id AND w.r = m.i)")],
    "v04_scores": [_v("score_float", "row_num", "whole", "s IS NULL")],
    "v05_monotonic": [_v("score_order", "r", "seq", "s < next_s")],
    "v06_ties": [_v("tie_order", "r", "seq", "s = next_s AND id > next_id")],
}


def _check(name, check):
    @query(name, HANDED + " UNION ALL ".join(V_SQL[name]))
    def run(spark, sf):
        return check(tb.flat(spark, sf, "handed_in"), ["job_id"])


for _name, _fn in zip(V_SQL, qa.CHECKS):
    _check(_name, _fn)


# Header lines of the lists as handed in: some with two cells changed over, a cell too few, or none at all.
D_HEADERS = """(SELECT job_id, CASE job_id % 7 WHEN 2 THEN 'candidate_id,score,rank,reasoning' WHEN 3 THEN 'candidate_id,rank,score' WHEN 5 THEN ''
  ELSE 'candidate_id,rank,score,reasoning' END AS line FROM (SELECT DISTINCT job_id FROM handed_in) j) h"""
V_HEADER = _v("header", "line", D_HEADERS, "line <> 'candidate_id,rank,score,reasoning'")


def _headers(spark, sf):
    lists = tb.flat(spark, sf, "handed_in").select("job_id").distinct()
    names = {2: ["candidate_id", "score", "rank", "reasoning"], 3: qa.HEADER[:3]}
    header = F.when(F.col("job_id") % 7 == 5, F.lit(None))
    for left, cells in names.items():
        header = header.when(F.col("job_id") % 7 == left, F.array(*map(F.lit, cells)))
    return lists.withColumn("header", header.otherwise(F.array(*map(F.lit, qa.HEADER))))


@query("v01_header", tb.with_flat("handed_in") + V_HEADER)
def v01_header(spark, sf):
    return qa.check_header(_headers(spark, sf), ["job_id"])


@query("v_all_violations", HANDED + f"SELECT rule, count(*) AS n FROM ({' UNION ALL '.join([V_HEADER, *(p for ps in V_SQL.values() for p in ps)])}) v GROUP BY rule")
def v_all(spark, sf):
    return qa.violations(tb.flat(spark, sf, "handed_in"), _headers(spark, sf), ["job_id"]).groupBy("rule").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ analytics

def d_top(rows: str, extra: tuple[str, ...] = ()) -> str:
    return tb.d_results(*extra) + f"""SELECT job_id, name, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY count DESC, name) AS rank FROM (
  SELECT job_id, name, count(*) AS count FROM ({rows}) x GROUP BY 1, 2) y) z WHERE rank <= 5"""


def _known(c: str, more: str = "") -> str:
    return f"{c} <> '' AND lower({c}) NOT IN ('unknown', 'not specified'{more})"


@query("n01_top_missing_skills", d_top("SELECT job_id, line AS name FROM entry WHERE list = 'missing_skills'"))
def n01(spark, sf):
    return na.top_missing(tb.results(spark, sf, profile=False))


@query("n02_top_universities", d_top(f"SELECT r.job_id, trim(e.institution) AS name FROM result r JOIN cand_edu e USING (candidate_id) WHERE {_known('trim(e.institution)')}", ("cand_edu",)))
def n02(spark, sf):
    return na.top_universities(tb.flat(spark, sf, "result"), tb.candidates(spark, sf, ("education",)))


@query("n03_top_locations", d_top(f"SELECT job_id, location AS name FROM res WHERE {_known('location')}"))
def n03(spark, sf):
    return na.top_locations(tb.flat(spark, sf, "result"), build_profile(tb.candidates(spark, sf, ())))


@query("n04_work_modes", RES + f"""SELECT r.job_id, upper(work_mode[1]) || lower(work_mode[2:]) AS range, count(*) AS count FROM result r JOIN cand USING (candidate_id)
WHERE {_known('work_mode')} GROUP BY 1, 2""")
def n04(spark, sf):
    return na.work_modes(tb.flat(spark, sf, "result"), tb.candidates(spark, sf, ()))


@query("n05_education_tiers", tb.d_results("cand_edu") + "SELECT r.job_id, 'Tier ' || tier AS range, count(*) AS count FROM result r JOIN cand_edu USING (candidate_id) GROUP BY 1, 2")
def n05(spark, sf):
    return na.education_tiers(tb.flat(spark, sf, "result"), tb.candidates(spark, sf, ("education",)))


D_METRICS = """SELECT job_id, count(*) AS cohort_size, count(*) FILTER (is_honeypot) AS honeypots_detected_in_cohort,
  round(coalesce(sum(final_score) FILTER (rank <= 100), 0) / 100, 4) AS top_100_average_score FROM result GROUP BY 1"""


@query("n06_pipeline_health", RES + f"""SELECT m.*, (SELECT count(*) FROM embeddings) AS candidate_count, (SELECT max(len(embedding)) FROM embeddings) AS embedding_dimension,
round(honeypots_detected_in_cohort::DOUBLE / cohort_size, 6) AS honeypot_rate FROM ({D_METRICS}) m""")
def n06(spark, sf):
    from candisieve.sources.results import run_metrics
    out = na.pipeline_health(tb.load(spark, sf, "embeddings"), run_metrics(tb.flat(spark, sf, "result")))
    return out.withColumn("honeypot_rate", F.round("honeypot_rate", 6))


def d_histogram(value: str, bounds, where: str = "true") -> str:
    arms = " ".join(f"WHEN {value} <= {b} THEN '{n}'" for n, b in bounds if b is not None)
    names = ", ".join(f"('{n}')" for n, _ in bounds)
    return RES + f"""SELECT j.job_id, b.range, coalesce(c.n, 0) AS count FROM (SELECT DISTINCT job_id FROM res WHERE {where}) j CROSS JOIN (VALUES {names}) b(range)
LEFT JOIN (SELECT job_id, CASE {arms} ELSE '{bounds[-1][0]}' END AS range, count(*) AS n FROM res WHERE {where} GROUP BY 1, 2) c ON c.job_id = j.job_id AND c.range = b.range"""


@query("n07_score_histogram", d_histogram("final_score", [("0-30 pts", 30), ("31-60 pts", 60), ("61-90 pts", 90), ("91-120 pts", 120), ("121-150 pts", None)]))
def n07(spark, sf):
    return na.score_histogram(tb.flat(spark, sf, "result"))


@query("n08_experience_histogram", d_histogram("years", [("0-2 yrs", 2), ("3-5 yrs", 5), ("6-9 yrs", 9), ("10+ yrs", None)]))
def n08(spark, sf):
    return na.experience_histogram(tb.results(spark, sf))


@query("n09_notice_histogram", d_histogram("notice_days", [("Immediate", 0), ("1-30 days", 30), ("31-60 days", 60), ("60+ days", None)]))
def n09(spark, sf):
    return na.notice_histogram(tb.results(spark, sf))


@query("n10_top_skills", d_top(f"SELECT r.job_id, trim(k.name) AS name FROM result r JOIN cand_skill k USING (candidate_id) WHERE {_known('trim(k.name)')}", ("cand_skill",)))
def n10(spark, sf):
    return na.top_skills(tb.results(spark, sf))


@query("n11_top_companies", d_top("SELECT job_id, trim(current_company) AS name FROM res WHERE " + _known("trim(current_company)", ", 'none'")))
def n11(spark, sf):
    return na.top_companies(tb.results(spark, sf))


@query("n12_risk_distribution", RES + """SELECT job_id, 'Verified Clear' AS range, count(*) FILTER (NOT is_honeypot) AS count FROM result GROUP BY 1
UNION ALL SELECT job_id, 'Flagged Risk', count(*) FILTER (is_honeypot) FROM result GROUP BY 1""")
def n12(spark, sf):
    return na.risk_distribution(tb.flat(spark, sf, "result"))


@query("n13_average_subscores", RES + "SELECT job_id, " + ", ".join(
    f"round(avg({p}_score), 6) AS {p}" for p in ["skill", "experience", "education", "project", "behavior", "availability"]) + " FROM result GROUP BY 1")
def n13(spark, sf):
    out = na.avg_subscores(tb.flat(spark, sf, "result"))
    return out.select("job_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("n14_kpis", RES + """SELECT job_id, count(*) AS total, max(final_score) AS highest_score, round(avg(final_score), 6) AS average_score,
CAST(floor(count(*) FILTER (open_to_work)::DOUBLE / count(*) * 100 + 0.5) AS BIGINT) AS open_to_work_pct, count(*) FILTER (is_honeypot) AS flagged, count(*) FILTER (NOT is_honeypot) AS verified FROM res GROUP BY 1""")
def n14(spark, sf):
    return na.kpis(tb.results(spark, sf)).withColumn("average_score", F.round("average_score", 6))


# ------------------------------------------------------------------ exploration

def _d_found(needle: str) -> str:
    """Rows with the needle in any searched field."""
    def has(*fields: str) -> str:
        return "(" + " OR ".join(f"contains(lower({f}), '{needle}')" for f in fields) + ")"

    def any_has(table: str, *fields: str) -> str:
        return f"EXISTS (SELECT 1 FROM {table} k WHERE k.candidate_id = r.candidate_id AND {has(*('k.' + f for f in fields))})"
    years = "CASE WHEN years = floor(years) THEN CAST(CAST(years AS BIGINT) AS VARCHAR) ELSE CAST(years AS VARCHAR) END"
    plain = has("r.candidate_id", "reasoning", "current_title", "current_company", "location", "summary", years, "CAST(notice_days AS VARCHAR)")
    return tb.d_results("cand_skill", "cand_job", "cand_edu", "cand_cert") + f"""SELECT r.job_id, r.candidate_id FROM res r WHERE {plain}
OR {any_has('cand_skill', 'name')} OR {any_has('cand_job', 'company', 'title')} OR {any_has('cand_edu', 'degree', 'institution')} OR {any_has('cand_cert', 'name', 'issuer')}"""


@query("x01_search", _d_found("google"))
def x01(spark, sf):
    return xp.search(tb.results(spark, sf), " Google ").select(*KEYS)


@query("x01_search_number", _d_found("7.5"))
def x01_number(spark, sf):
    return xp.search(tb.results(spark, sf), "7.5").select(*KEYS)


@query("x01_search_days", _d_found("90"))
def x01_days(spark, sf):
    return xp.search(tb.results(spark, sf), "90").select(*KEYS)


def _indexed(spark, sf):
    rows, path = materialize(xp.searched_columns(tb.results(spark, sf), *KEYS), "results"), scratch_path(spark, "search")
    sx.write_search_index(rows, path)
    return rows, path


@query("x01_indexed_search", _d_found("google"))
def x01_indexed(spark, sf):
    rows, path = _indexed(spark, sf)
    return sx.indexed_search(rows, path, " Google ").select(*KEYS)


_PIECES = " AND ".join(f"contains(t, '{piece}')" for piece in ("eng", "ngi", "gin", "ine", "nee", "eer"))
_D_TEXTS = " UNION ".join(f"SELECT lower({field}) AS t FROM {table}" for table, fields in {
    "res": ["candidate_id", "reasoning", "location", *[d_raw(c) for c in ("current_title", "current_company", "summary")],
            "CASE WHEN years = floor(years) THEN CAST(CAST(years AS BIGINT) AS VARCHAR) ELSE CAST(years AS VARCHAR) END", "CAST(notice_days AS VARCHAR)"],
    "cand_skill k WHERE k.candidate_id IN (SELECT candidate_id FROM res)": ["name"],
    "cand_job k WHERE k.candidate_id IN (SELECT candidate_id FROM res)": ["company", "title"],
    "cand_edu k WHERE k.candidate_id IN (SELECT candidate_id FROM res)": ["degree", "institution"],
    "cand_cert k WHERE k.candidate_id IN (SELECT candidate_id FROM res)": ["name", "issuer"]}.items() for field in fields)


# How many different texts there are, and how many of them the search has to compare with its needle.
@query("x01_texts_compared", tb.d_results("cand_skill", "cand_job", "cand_edu", "cand_cert") + f"""SELECT count(*) AS n_texts,
count(*) FILTER ({_PIECES}) AS n_with_all_pieces, count(*) FILTER (contains(t, 'engineer')) AS n_found, true AS skips FROM ({_D_TEXTS}) WHERE t IS NOT NULL""")
def x01_compared(spark, sf):
    rows, path = _indexed(spark, sf)
    discard(rows)
    # With as many pieces as the needle has, the texts compared are those that hold them all.
    few = sx.compared_texts(spark, path, "engineer").agg(F.count("*").alias("n_compared"))
    every = sx.compared_texts(spark, path, "engineer", most_grams=6).agg(
        F.count("*").alias("n_with_all_pieces"), F.count_if("found").alias("n_found"))
    counts = spark.read.parquet(f"{path}/texts").agg(F.count("*").alias("n_texts")).join(every).join(few)
    return counts.select("n_texts", "n_with_all_pieces", "n_found", (
        F.col("n_compared").between(F.col("n_with_all_pieces"), F.col("n_texts") - 1)).alias("skips"))


@query("x02_sort", RES + "SELECT job_id, candidate_id, rank, final_score FROM result")
def x02(spark, sf):
    return xp.sort_results(tb.flat(spark, sf, "result"), "score", "desc").select(*KEYS, "rank", "final_score")


@query("x03_facets", RES + """SELECT job_id, candidate_id FROM res WHERE NOT is_honeypot AND open_to_work AND notice_days <= 30 AND years > 5 AND years <= 9 AND contains(lower(location), 'city')""")
def x03(spark, sf):
    return xp.filter_results(tb.results(spark, sf), risk="low", open_to_work="yes", notice="short", experience="6-9", location="City").select(*KEYS)


@query("x04_page", RES + "SELECT job_id, candidate_id, rank FROM result ORDER BY final_score DESC, job_id, candidate_id LIMIT 25 OFFSET 50")
def x04(spark, sf):
    return xp.page(tb.flat(spark, sf, "result"), 3, 25, "score", "desc").select(*KEYS, "rank")


@query("x04_stored_page", RES + "SELECT job_id, candidate_id, rank FROM result ORDER BY final_score DESC, job_id, candidate_id LIMIT 25 OFFSET 50")
def x04_stored(spark, sf):
    path = scratch_path(spark, "pages")
    xp.write_pages(tb.flat(spark, sf, "result"), path, "score", "desc")
    return xp.stored_page(spark, path, 3, 25, "score", "desc").select(*KEYS, "rank")


@query("x05_enrich", RES + f"""SELECT r.job_id, r.candidate_id, r.rank, r.final_score AS score, r.name, CASE WHEN r.rank % 3 = 0 THEN -1.0::DOUBLE ELSE r.skill_score END AS skill_score,
CASE WHEN r.rank % 3 = 0 THEN '' ELSE coalesce({d_agg("'matched_skills'", 'line')}, '') END AS matched FROM res r""")
def x05(spark, sf):
    rows = tb.results(spark, sf)
    ranked = rows.select(*KEYS, "rank", F.col("final_score").alias("score"), "reasoning")
    none = F.expr("cast(array() as array<string>)")

    def fresh(pairs):
        """A stand-in for scoring: the row with a marker score and no lists."""
        return rows.join(pairs, KEYS, "left_semi").withColumn("skill_score", F.lit(-1.0)).withColumn("matched_skills", none)
    out = xp.enrich(ranked, rows.filter("rank % 3 <> 0"), fresh)
    return out.select(*KEYS, "rank", "score", "name", "skill_score", F.array_join("matched_skills", " | ").alias("matched"))


@query("x06_detail", RES + f"""SELECT r.job_id, r.candidate_id, r.name, r.location, CASE WHEN r.rank % 2 = 0 THEN r.final_score ELSE 0 END::DOUBLE AS final_score,
CASE WHEN r.rank % 2 = 0 THEN r.is_honeypot ELSE false END AS is_honeypot, CASE WHEN r.rank % 2 = 0 THEN coalesce({d_agg("'missing_skills'", 'line')}, '') ELSE '' END AS missing,
CASE WHEN r.rank % 2 = 0 THEN r.reasoning ELSE 'Job description is not configured or could not be loaded.' END AS reasoning FROM res r""")
def x06(spark, sf):
    rows = tb.results(spark, sf)
    out = xp.detail(rows.select(*KEYS), build_profile(tb.candidates(spark, sf, ())), rows.filter("rank % 2 = 0"))
    return out.select(*KEYS, "name", "location", "final_score", "is_honeypot", F.array_join("missing_skills", " | ").alias("missing"), "reasoning")
