"""Checking SQL of the skill matching: flat joins instead of row arrays."""

from __future__ import annotations

from candisieve.functions import fixed_values as fv
from candisieve.functions.text import reverse_aliases
from workloads import testbed as tb
from workloads.profile_queries import D_PROFILE, D_WORK
from workloads.registry import d_list, d_map_case, d_norm

ALIAS_OF = reverse_aliases(fv.SKILL_ALIASES)
CERT_OF = reverse_aliases(fv.CERT_ALIASES)

D_CERT_SIGNAL = (r"'\b(?:certifications?|certified|cert|certs|adm-\d+|pd1|pd2"
                 r"|platform developer\s*(?:i/ii|i|ii|1/2|1|2)?|platform app builder)\b'")


def d_escape(c: str) -> str:
    return rf"regexp_replace({c}, '([^A-Za-z0-9 ])', '\\\1', 'g')"


def d_bound(needle: str, text: str) -> str:
    return rf"regexp_matches({text}, '\b' || {d_escape(needle)} || '\b')"


def d_alnum_bound(needle: str, text: str) -> str:
    return f"regexp_matches({text}, '(^|[^a-zA-Z0-9])' || {d_escape(needle)} || '($|[^a-zA-Z0-9])')"


def d_is_cert(norm: str) -> str:
    names = list(fv.CERT_ALIASES) + list(CERT_OF)
    return f"(regexp_matches({norm}, {D_CERT_SIGNAL}) OR {norm} IN {d_list(names)})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
                                     for v in row) + ")" for row in rows)


_EQ = [(k, d) for k, ds in fv.EQUIVALENT_DOMAINS.items() for d in ds]
_SUP = [(k, d) for k, ds in fv.SUPPORTED_DOMAINS.items() for d in ds]
_RIVAL = [(i, m) for i, g in enumerate(fv.COMPETITOR_GROUPS) for m in g]
_SIM = list(fv.SIMILAR_SKILLS) + [(b, a, v) for a, b, v in fv.SIMILAR_SKILLS]
_TERMS = sorted({t for ts in fv.ONTOLOGY.values() for t in ts})
_TERM_ROWS = [
    (t, "many" if " " in t else "alpha" if t.isalpha() else "symbol",
     t.replace("-", " ").replace("_", " ").replace("/", " ")) for t in _TERMS]

D_SPACED_LINE = "regexp_replace(lower(line), '[-_/]', ' ', 'g')"

# Job side: ontology terms per line, critical skills, units, constituents.
D_JOB_SIDE = f"""
term(term, kind, spaced) AS (VALUES {_values(_TERM_ROWS)}),
line_text AS (SELECT DISTINCT line FROM job_line),
line_term AS (SELECT line, term FROM line_text CROSS JOIN term WHERE CASE kind
    WHEN 'many' THEN contains({D_SPACED_LINE}, spaced)
    WHEN 'alpha' THEN regexp_extract(line, '(?i)\\b' || term || '\\b') <> ''
      AND regexp_extract(line, '(?i)\\b' || term || '\\b') <> lower(regexp_extract(line, '(?i)\\b' || term || '\\b'))
    ELSE {d_alnum_bound('spaced', D_SPACED_LINE)} END),
job_term AS (SELECT DISTINCT job_id, term FROM job_line JOIN line_term USING (line) WHERE kind = 'required'),
critical AS (SELECT job_id, term FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY term) AS r FROM job_term) WHERE r <= 2),
weighted AS (SELECT l.job_id, row_number() OVER (PARTITION BY l.job_id ORDER BY l.idx) - 1 AS idx, l.kind, l.line, lower(trim(l.line)) AS norm,
    CASE WHEN l.kind <> 'required' THEN false
         WHEN l.job_id IN (SELECT job_id FROM critical)
           THEN EXISTS (SELECT 1 FROM critical c JOIN line_term t USING (term) WHERE c.job_id = l.job_id AND t.line = l.line)
         ELSE l.idx < 2 END AS is_critical
  FROM job_line l WHERE NOT (l.kind = 'preferred' AND lower(l.line) = 'none specified')),
weights AS (SELECT *, CASE WHEN is_critical THEN 1.0::DOUBLE WHEN kind = 'required' THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM weighted),
part AS (SELECT w.job_id, w.idx, t.idx AS part_pos, t.name AS part, lower(trim(t.name)) AS norm FROM weights w JOIN job_tech t USING (job_id)
  WHERE length(trim(t.name)) >= 2 AND lower(trim(t.name)) NOT IN {d_list(fv.GENERIC_SKILL_WORDS)}
    AND ({d_alnum_bound('lower(trim(t.name))', 'lower(w.line)')}
      OR {d_alnum_bound("regexp_replace(lower(trim(t.name)), '[-_/]', ' ', 'g')", "regexp_replace(lower(w.line), '[-_/]', ' ', 'g')")}))"""

_STOP = d_list(fv.COMPOSITE_STOPWORDS + fv.BROAD_TERMS)

# The ladder for every distinct requirement text of a job and every applicant.
D_LADDER = f"""
eq(req, dom) AS (VALUES {_values(_EQ)}), sup(req, dom) AS (VALUES {_values(_SUP)}),
rival(grp, member) AS (VALUES {_values(_RIVAL)}), simt(a, b, v) AS (VALUES {_values(_SIM)}),
unit AS (SELECT job_id, norm, {d_map_case('norm', ALIAS_OF)} AS canon, {d_is_cert('norm')} AS is_cert,
    {d_map_case('norm', CERT_OF)} AS cert, {d_map_case('norm', fv.SIMILARITY_SYNONYMS)} AS sim
  FROM (SELECT job_id, norm FROM weights UNION SELECT job_id, norm FROM part) x),
sk AS (SELECT *, {d_map_case('norm', ALIAS_OF)} AS canon, {d_map_case('norm', fv.SIMILARITY_SYNONYMS)} AS sim FROM (
  SELECT candidate_id, pos, name, proficiency, coalesce(months, 0) AS months, lower(trim(name)) AS norm FROM cand_skill) x),
career AS (SELECT candidate_id, text, regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g') AS ascii_text FROM (
  SELECT c.candidate_id, {d_norm(f"{D_PROFILE} || ' ' || coalesce(w.work_history_text, '')")} AS text
  FROM cand c LEFT JOIN {D_WORK} w USING (candidate_id)) x),
title_text AS (SELECT candidate_id, lower(trim(title)) AS t FROM cand UNION SELECT candidate_id, lower(trim(title)) FROM cand_job WHERE title <> ''),
un AS (SELECT DISTINCT norm, canon, sim FROM unit), sn AS (SELECT DISTINCT norm, canon, sim FROM sk),
tok AS (SELECT DISTINCT norm, w FROM (SELECT norm, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS w FROM un) x WHERE length(w) >= 3 AND w NOT IN {_STOP}),
ntok AS (SELECT norm, count(*) AS n FROM tok GROUP BY norm HAVING count(*) >= 3),
stok AS (SELECT DISTINCT norm, w FROM (SELECT norm, unnest(regexp_extract_all(norm || ' ' || canon, '[a-z0-9]+')) AS w FROM sn) x WHERE length(w) >= 3 AND w NOT IN {_STOP}),
-- facts about one skill name and one requirement name
fact AS (SELECT u.norm AS u_norm, s.norm AS s_norm,
    (s.canon = u.canon OR s.norm = u.norm) AS direct,
    CASE WHEN u.canon = 'bge' AND regexp_matches(s.norm, '\\bbge\\b') THEN 0
      WHEN u.canon = 'python' AND regexp_matches(s.norm, '\\bpython\\b') THEN 0
      WHEN u.canon = 'python' AND regexp_matches(s.norm, '\\bpython\\s*\\d+(\\.\\d+)?\\b') THEN 1
      WHEN u.canon = 'faiss' AND regexp_matches(s.norm, '\\bfaiss\\b') THEN 0
      WHEN u.canon = 'faiss' AND regexp_matches(s.norm, '\\bfacebook\\s+ai\\s+similarity\\s+search\\b') THEN 1
      WHEN u.canon = 'sentence transformers' AND regexp_matches(s.norm, '\\bsentence[\\s\\-_]*transformers?\\b') THEN 0
      WHEN u.canon = 'lora' AND regexp_matches(s.norm, '\\blora\\b') THEN 0
      WHEN u.canon = 'lora' AND regexp_matches(s.norm, '\\bqlora\\b') THEN 1 END AS family,
    EXISTS (SELECT 1 FROM eq WHERE eq.req = u.canon AND eq.dom = s.canon) AS equivalent,
    EXISTS (SELECT 1 FROM sup WHERE sup.req = u.canon AND sup.dom = s.canon) AS supported,
    (s.canon <> u.canon AND s.norm <> u.norm AND EXISTS (SELECT 1 FROM rival r JOIN rival q ON q.grp = r.grp
      WHERE r.member IN (u.canon, u.norm) AND q.member IN (s.canon, s.norm))) AS is_rival,
    ((length(s.norm) >= 3 AND {d_bound('s.norm', 'u.norm')}) OR (length(s.canon) >= 3 AND {d_bound('s.canon', 'u.norm')})) AS named,
    CASE WHEN s.norm = u.norm OR s.sim = u.sim OR {d_bound('s.sim', 'u.sim')} OR {d_bound('u.sim', 's.sim')} THEN 1.0::DOUBLE
      ELSE coalesce((SELECT max(v) FROM simt WHERE simt.a = s.sim AND simt.b = u.sim), 0)::DOUBLE END AS similarity
  FROM un u CROSS JOIN sn s),
pu AS (SELECT a.job_id, a.candidate_id, u.* EXCLUDE (job_id) FROM application a JOIN unit u USING (job_id)),
agg AS (SELECT pu.job_id, pu.candidate_id, pu.norm,
    min(pos) FILTER (direct) AS a_pos, min(family * 100000 + pos) FILTER (family IS NOT NULL) % 100000 AS b_pos,
    min(pos) FILTER (equivalent) AS eq_pos, min(pos) FILTER (supported) AS sup_pos, min(pos) FILTER (is_rival) AS f_pos,
    min(pos) FILTER (named) AS g_pos, max_by(pos, similarity * 100000 - pos) AS h_pos, max(similarity) AS h_sim
  FROM pu JOIN sk USING (candidate_id) JOIN fact ON fact.u_norm = pu.norm AND fact.s_norm = sk.norm GROUP BY ALL),
cover AS (SELECT pu.job_id, pu.candidate_id, pu.norm, count(DISTINCT stok.w)::DOUBLE / any_value(ntok.n) AS cover
  FROM pu JOIN ntok USING (norm) JOIN sk USING (candidate_id) JOIN fact ON fact.u_norm = pu.norm AND fact.s_norm = sk.norm AND fact.named
  JOIN stok ON stok.norm = sk.norm GROUP BY ALL),
claim AS (SELECT DISTINCT pu.job_id, pu.candidate_id, pu.norm FROM pu JOIN title_text t USING (candidate_id) WHERE contains(t.t, pu.canon) OR contains(t.t, pu.norm)),
certs AS (SELECT pu.job_id, pu.candidate_id, pu.norm, arg_min(c.name, c.pos) AS name FROM pu JOIN (
    SELECT candidate_id, pos, name, lower(trim(name)) AS cnorm FROM cand_cert) c USING (candidate_id)
  WHERE pu.is_cert AND (pu.cert = {d_map_case('c.cnorm', CERT_OF)} OR pu.norm = c.cnorm) GROUP BY ALL),
facts AS (SELECT pu.*, ct.name AS cert_name, g.a_pos, g.b_pos, g.eq_pos, g.sup_pos, g.f_pos, g.g_pos, g.h_pos, g.h_sim, hs.norm AS h_norm,
    cv.cover, cl.norm IS NOT NULL AS claimed,
    (contains(t.text, pu.norm) OR contains(t.text, pu.canon)) AS in_text,
    EXISTS (SELECT 1 FROM eq WHERE eq.req = pu.canon AND contains(t.text, eq.dom)) AS eq_in_text,
    CASE pu.canon WHEN 'bge' THEN regexp_matches(t.ascii_text, '\\bbge\\b')
      WHEN 'python' THEN regexp_matches(t.ascii_text, '\\bpython\\b|\\bpython\\s*\\d+(\\.\\d+)?\\b')
      WHEN 'faiss' THEN regexp_matches(t.ascii_text, '\\bfaiss\\b|\\bfacebook\\s+ai\\s+similarity\\s+search\\b')
      WHEN 'sentence transformers' THEN regexp_matches(t.ascii_text, '\\bsentence[\\s\\-_]*transformers?\\b')
      WHEN 'lora' THEN regexp_matches(t.ascii_text, '\\bq?lora\\b') ELSE false END AS family_in_text
  FROM pu LEFT JOIN agg g USING (job_id, candidate_id, norm) LEFT JOIN cover cv USING (job_id, candidate_id, norm)
  LEFT JOIN claim cl USING (job_id, candidate_id, norm) LEFT JOIN certs ct USING (job_id, candidate_id, norm)
  LEFT JOIN sk hs ON hs.candidate_id = pu.candidate_id AND hs.pos = g.h_pos JOIN career t ON t.candidate_id = pu.candidate_id),
rung AS (SELECT *, CASE WHEN is_cert THEN 'cert' WHEN a_pos IS NOT NULL THEN 'A' WHEN b_pos IS NOT NULL THEN 'B' WHEN claimed THEN 'C'
    WHEN eq_pos IS NOT NULL OR sup_pos IS NOT NULL THEN 'D' WHEN family_in_text THEN 'E' WHEN f_pos IS NOT NULL THEN 'F'
    WHEN cover >= 0.60 THEN 'G'
    WHEN h_sim > 0 AND (h_sim >= 0.70 OR h_norm IN {d_list(fv.BROAD_TERMS)}) THEN 'H'
    WHEN in_text THEN 'I' ELSE '-' END AS rung FROM facts),
cls AS (SELECT job_id, candidate_id, norm, rung, cert_name,
    CASE rung WHEN 'cert' THEN CASE WHEN cert_name IS NOT NULL THEN 'DIRECT' ELSE 'NONE' END WHEN 'A' THEN 'DIRECT' WHEN 'B' THEN 'DIRECT'
      WHEN 'C' THEN CASE WHEN eq_pos IS NOT NULL OR sup_pos IS NOT NULL OR eq_in_text THEN 'EQUIVALENT' ELSE 'SUPPORTED' END
      WHEN 'D' THEN CASE WHEN eq_pos IS NOT NULL THEN 'EQUIVALENT' ELSE 'SUPPORTED' END WHEN 'E' THEN 'SUPPORTED'
      WHEN 'F' THEN CASE WHEN in_text THEN 'SUPPORTED' ELSE 'RELATED' END WHEN 'G' THEN 'EQUIVALENT'
      WHEN 'H' THEN CASE WHEN h_norm IN {d_list(fv.BROAD_TERMS)} THEN 'RELATED' WHEN in_text THEN 'SUPPORTED' ELSE 'RELATED' END
      WHEN 'I' THEN 'SUPPORTED' ELSE 'NONE' END AS cls,
    CASE rung WHEN 'A' THEN a_pos WHEN 'B' THEN b_pos WHEN 'D' THEN coalesce(eq_pos, sup_pos) WHEN 'F' THEN CASE WHEN in_text THEN f_pos END
      WHEN 'G' THEN g_pos WHEN 'H' THEN CASE WHEN h_norm NOT IN {d_list(fv.BROAD_TERMS)} AND in_text THEN h_pos END END AS skill_pos,
    CASE rung WHEN 'G' THEN cover WHEN 'H' THEN h_sim END AS measure FROM rung),
hit AS (SELECT c.*, coalesce(c.cert_name, s.name) AS skill, s.proficiency, s.months, c.cert_name IS NOT NULL AS is_cert_hit
  FROM cls c LEFT JOIN sk s ON s.candidate_id = c.candidate_id AND s.pos = c.skill_pos)"""

D_PROF = ("CASE WHEN contains(lower(coalesce(proficiency, '')), 'expert') THEN 1.2 "
          "WHEN regexp_matches(lower(coalesce(proficiency, '')), 'advanced|lead') THEN 1.1 ELSE 1.0 END")

# Own class, then the constituent that replaces it.
D_CLASSIFIED = f"""
own AS (SELECT a.job_id, a.candidate_id, w.idx, w.line, w.norm, w.kind, w.is_critical, w.weight, h.cls, h.rung, h.skill, h.proficiency, h.months, h.is_cert_hit, h.measure
  FROM application a JOIN weights w USING (job_id) JOIN hit h ON h.job_id = a.job_id AND h.candidate_id = a.candidate_id AND h.norm = w.norm),
part_hit AS (SELECT h.candidate_id, p.job_id, p.idx, p.part_pos, p.part, h.cls, h.rung, h.skill, h.proficiency, h.months, h.is_cert_hit, h.measure,
    CASE WHEN h.cls IN ('DIRECT', 'EQUIVALENT') THEN 1 ELSE 2 END AS tier
  FROM part p JOIN hit h ON h.job_id = p.job_id AND h.norm = p.norm WHERE h.cls IN ('DIRECT', 'EQUIVALENT', 'SUPPORTED')),
best_part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id, idx ORDER BY tier,
    CASE WHEN tier = 1 THEN {D_PROF} END DESC, CASE WHEN tier = 1 THEN coalesce(months, 0) END DESC, part_pos) AS r FROM part_hit) WHERE r = 1),
classified AS (SELECT o.job_id, o.candidate_id, o.idx, o.line, o.norm, o.kind, o.is_critical, o.weight,
    CASE WHEN b.idx IS NULL THEN o.cls ELSE b.cls END AS cls, CASE WHEN b.idx IS NULL THEN o.rung ELSE b.rung END AS rung,
    CASE WHEN b.idx IS NULL THEN o.skill ELSE b.skill END AS skill, CASE WHEN b.idx IS NULL THEN o.proficiency ELSE b.proficiency END AS proficiency,
    CASE WHEN b.idx IS NULL THEN o.months ELSE b.months END AS months, CASE WHEN b.idx IS NULL THEN o.is_cert_hit ELSE b.is_cert_hit END AS is_cert_hit,
    CASE WHEN b.idx IS NULL THEN o.measure ELSE b.measure END AS measure, b.part AS via
  FROM own o LEFT JOIN best_part b ON b.job_id = o.job_id AND b.candidate_id = o.candidate_id AND b.idx = o.idx
    AND o.cls IN ('NONE', 'RELATED') AND (b.tier = 1 OR o.cls = 'NONE'))"""

# Cohort rarity of a requirement name.
D_RARITY = """
cohort AS (SELECT job_id, count(*) AS n FROM application GROUP BY 1),
rarity AS (SELECT a.job_id, lower(trim(s.name)) AS skill, greatest(1.0, least(2.0, 1.0 + (1.0 - count(*)::DOUBLE / any_value(c.n)))) AS rarity
  FROM application a JOIN cand_skill s USING (candidate_id) JOIN cohort c ON c.job_id = a.job_id GROUP BY 1, 2)"""

FLAT_JOB = tb.with_flat("job", "job_line", "job_tech").rstrip()
FLAT_PAIR = tb.with_flat("cand", "cand_skill", "cand_job", "cand_cert", "job", "job_line", "job_tech", "application").rstrip()
JOB_SQL = f"{FLAT_JOB}, {D_JOB_SIDE}\n"
LADDER_SQL = f"{FLAT_PAIR}, {D_JOB_SIDE}, {D_LADDER}\n"
CLASSIFIED_SQL = f"{FLAT_PAIR}, {D_JOB_SIDE}, {D_LADDER}, {D_CLASSIFIED}\n"
