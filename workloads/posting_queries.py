"""J01-J21 over postings wrapped around every given document."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions import fixed_values as fv
from candisieve.operators import extraction as jx
from workloads import testbed as tb
from workloads.posting_values import HEADERS, NAMES
from workloads.registry import d_list, query
from workloads.skill_sql import D_CERT_SIGNAL

_W = "A-Za-z0-9_À-ÖØ-öø-ÿ"  # word characters of the given texts


def _q(text: str) -> str:
    """A literal inside an RE2 pattern inside an SQL string."""
    out = "".join("\\" + ch if ch in ".+*?()[]{}|^$\\/&" and ch not in "/&" else ch for ch in text)
    return out.replace("'", "''")


def d_pre(c: str) -> str:
    """RE2 looks neither back nor ahead: each name is one private character while gaps are spaced, and
    headers go line by line from the longest on."""
    held = {name: f"chr({0xE000 + i})" for i, name in enumerate(sorted(NAMES, key=len, reverse=True))}

    def swap(pattern: str, by: str) -> None:
        nonlocal c
        c = f"regexp_replace({c}, '{pattern}', {by}, 'g')"
    for name, char in held.items():
        swap(rf"(?i)\b{_q(name)}\b", char)
    swap(r"([\)\]\.\?!:])([a-zA-Z])", r"'\1 \2'")
    swap(r"([a-zA-Z0-9]),([A-Z])", r"'\1, \2'")
    swap(r"(?i)([a-zA-Z])(\d+\+?\s*(?:to|-|–|—)?\s*\d*\s*(?:years?|yrs?)\b)", r"'\1' || chr(10) || '\2'")
    for name, char in held.items():
        c = f"replace({c}, {char}, '{name}')"
    for header in sorted(HEADERS, key=len, reverse=True):
        if header in ("Certifications", "KPIs"):
            swap(rf"([a-z0-9])({header})", r"'\1' || chr(10) || '\2'")
            swap(rf"([ \t\r])({header})([:\s]|$)", r"'\1' || chr(10) || '\2\3'")
        else:
            swap(rf"(?i)(^|[^\n{_W}]|[a-z0-9])({_q(header)})", r"'\1' || chr(10) || '\2'")
    swap(r"([a-z0-9])(Location)([:\s]|$)", r"'\1' || chr(10) || '\2\3'")
    return c


def d_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def d_bullets(c: str) -> str:
    return d_strip(rf"regexp_replace({d_strip(c)}, '^[•*\-\d.\s]+\s*', '')")


D_HEADER = (r"trim(regexp_replace(lower(split_part(trim(regexp_replace(line, '^\s*#+\s*', '')), ':', 1)), '[^a-zA-Z\s]', '', 'g'))")
BASE = tb.with_flat("posting").rstrip() + rf""", pre AS MATERIALIZED (SELECT job_id, {d_pre('raw_text')} AS text FROM posting),
raw_ln AS MATERIALIZED (SELECT job_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pre),
ln AS MATERIALIZED (SELECT job_id, n, line, {D_HEADER} AS header FROM (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY n) AS n, {d_strip('line')} AS line
  FROM raw_ln WHERE {d_strip('line')} <> '') x)"""

_ALL_HEADERS = fv.SECTION_HEADERS + fv.PREFERENCE_HEADERS


def d_section(name: str, start: str, stops: list[str], section: str | None = None, gate: str = "true") -> str:
    headers = d_list(fv.SECTION_HEADERS if section == "skills" else _ALL_HEADERS)
    stop = " OR ".join([f"header IN {headers}"] + [f"regexp_matches(line, '(?i){s}')" for s in stops])
    after = d_strip(rf"regexp_replace({d_strip(f'''regexp_extract(line, '(?is)^.*?(?:{start})(.*)$', 1)''')}, '^[:\-]\s*', '')")
    return f"""{name}_s AS (SELECT job_id, min(n) AS s FROM ln JOIN pre USING (job_id) WHERE ({gate}) AND regexp_matches(line, '(?i){start}') GROUP BY 1),
{name}_e AS (SELECT l.job_id, min(n) AS e FROM ln l JOIN {name}_s USING (job_id) WHERE n > s AND ({stop}) GROUP BY 1),
{name} AS (SELECT * FROM (SELECT l.job_id, n, {d_bullets(after)} AS line FROM ln l JOIN {name}_s ON l.job_id = {name}_s.job_id AND n = s) a WHERE line <> ''
  UNION ALL SELECT l.job_id, n, {d_bullets('line')} FROM ln l JOIN {name}_s USING (job_id) LEFT JOIN {name}_e USING (job_id) WHERE n > s AND (e IS NULL OR n < e))"""


def d_headers(names) -> str:
    return r"^\s*(?:#+\s*)?(?:" + "|".join(_q(n) + r"s?\b" for n in names) + ")"


def d_first_filled(name: str, *sections: str) -> str:
    """The first section that has a line; blank lines are dropped from the result."""
    union = " UNION ALL ".join(f"SELECT {i} AS o, * FROM {s}" for i, s in enumerate(sections))
    return f"""{name} AS (SELECT job_id, n, {d_bullets('line')} AS line FROM ({union}) u
  WHERE o = (SELECT min(o) FROM ({union}) v WHERE v.job_id = u.job_id) AND trim(line) <> '')"""


def d_filled(name: str) -> str:
    return f"(SELECT job_id, n, line FROM {name} WHERE line <> '')"


def d_joined(name: str) -> str:
    return f"coalesce((SELECT string_agg(line, ' | ' ORDER BY n) FROM {name} x WHERE x.job_id = p.job_id), '')"


def _lined(spark, sf):
    return jx.with_lines(tb.postings(spark, sf))


def _show(c):
    return F.array_join(c, " | ")


@query("j01_preprocess", BASE + " SELECT job_id, text FROM pre")
def j01(spark, sf):
    return _lined(spark, sf).select("job_id", "text")


@query("j02_section_lines", f"{BASE}, {d_section('sec', 'Key Responsibilities', ['Qualifications & Requirements|Required Qualifications'])} SELECT p.job_id, {d_joined('sec')} AS section FROM pre p")
def j02(spark, sf):
    return _lined(spark, sf).select("job_id", _show(jx.section_lines(
        F.col("lines"), "Key Responsibilities", "Qualifications & Requirements|Required Qualifications")).alias("section"))


@query("j03_section_fallback", f"{BASE}, {d_section('sec', d_headers(jx.PREFERRED_HEADERS), [], 'skills')} SELECT p.job_id, {d_joined(d_filled('sec'))} AS section FROM pre p")
def j03(spark, sf):
    return _lined(spark, sf).select("job_id", _show(jx.section_fallback(
        F.col("lines"), jx.PREFERRED_HEADERS, section="skills")).alias("section"))


@query("j04_clean_bullets", f"{BASE} SELECT job_id, n AS pos, {d_bullets('line')} AS line FROM ln")
def j04(spark, sf):
    rows = _lined(spark, sf).select("job_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("pos"), jx.clean_bullets(F.col("line")).alias("line"))


def d_editorial(c: str) -> str:
    c = d_strip(c)
    for p in [r"\.\s*(?:We don''t care|We do not care)\b.*$", r"[.;]\s*(?:Again,?\s+the specific tech doesn''t matter|Again,?\s+the specific tech does not matter)\b.*$",
              r"\.\s*(?:Yes really,?\s+we care\b.*$)", r"\.\s*(?:If you''ve never|If you have never)\b.*$"]:
        c = d_strip(f"regexp_replace({c}, '(?i){p}', '')")
    return c


@query("j05_strip_editorial", f"{BASE} SELECT job_id, n AS pos, {d_editorial('line')} AS line FROM ln")
def j05(spark, sf):
    rows = _lined(spark, sf).select("job_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("pos"), jx.strip_editorial(F.col("line")).alias("line"))


_P = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def d_bare(c: str) -> str:
    return d_strip(f"regexp_replace({d_strip(c)}, '^{_P}+|{_P}+$', '', 'g')")


_LABEL = r"(?i)(?:^|\n)#?\s*(?:Job Description|Job Title|Title|Position Title|Position|Role)(?::|\s+-|\s+)*([^\n\r]+)"
_INVALID = d_list(fv.INVALID_TITLES)


def _d_prose(head: str, tail: str) -> str:
    return d_bare(rf"regexp_extract(text, '(?i){head}([^,.\n]{{3,80}})(?:,|{tail})', 1)")


D_TITLE = rf"""title_opts AS (SELECT p.job_id, CASE WHEN regexp_matches(text, '{_LABEL}') THEN {d_bare(f"regexp_extract(text, '{_LABEL}', 1)")} END AS a,
  (SELECT arg_min(t, n) FROM (SELECT job_id, n, {d_bare('line')} AS t FROM ln WHERE n <= 3) l WHERE l.job_id = p.job_id AND lower(t) NOT IN {_INVALID} AND length(t) < 80) AS b FROM pre p),
titled AS (SELECT job_id, regexp_replace(regexp_replace(CASE WHEN lower(a) NOT IN {_INVALID} AND length(a) < 80 THEN a WHEN b IS NOT NULL THEN b ELSE 'Not specified' END,
  '(?i)(?:-|\b)\s*\d+\+?\s*(?:to\s*\d+\s*)?(?:years?|yrs?)(?:\s*of\s*experience)?.*$', ''), '^[ :,-]+|[ :,-]+$', '', 'g') AS title FROM title_opts)"""


@query("j06_title", f"{BASE}, {D_TITLE} SELECT job_id, title FROM titled")
def j06(spark, sf):
    return _lined(spark, sf).select("job_id", jx.title(F.col("text"), F.col("lines")).alias("title"))


def _d_field(pattern: str, group: int = 1) -> str:
    return f"CASE WHEN regexp_matches(text, '{pattern}') THEN {d_strip(f'''regexp_extract(text, '{pattern}', {group})''')} END"


_LOC = _d_field(r"(?im)^(?:Location|Site|Workplace|City)(?::|\s)+([^\n]+)$")
D_LOGIC = rf"""fields AS (SELECT job_id, coalesce({_d_field(r'(?i)(?:Company|Organization|Employer):\s*(.*)')}, 'Not specified') AS company,
  coalesce(CASE WHEN starts_with(lower({_LOC}), 'hyderabad') THEN 'Hyderabad' ELSE {_LOC} END, 'Not specified') AS location,
  coalesce({_d_field(r'(?i)(?:Employment Type|Type|Job Type|Commitment):\s*(.*)')}, 'Not specified') AS employment_type FROM pre)"""


@query("j07_header_fields", f"{BASE}, {D_LOGIC} SELECT * FROM fields")
def j07(spark, sf):
    t = F.col("text")
    return _lined(spark, sf).select("job_id", jx.company(t).alias("company"), jx.location(t).alias("location"),
                                    jx.employment_type(t).alias("employment_type"))


_EXP = _d_field(r"(?im)^(?:Experience Required|Experience|Work Experience|Min Experience|Min\. Experience|Yrs of experience)(?::|\s)+([^\n]+)$")
_RANGE = r"(?i)(\d+(?:\.\d+)?)\s*(?:-|to|–|—|and up to)\s*(\d+(?:\.\d+)?)"
_SINGLE = r"(?i)(?:minimum\s+of|minimum|at least|min)?\s*(\d+(?:\.\d+)?)\s*(?:\+)?\s*(?:year|yr)"
D_EXP = rf"""expt AS (SELECT job_id, coalesce(nullif({_EXP}, ''), nullif(regexp_extract(text, '(?i)(\d+\+?\s*(?:to|-|–|—)\s*\d+\s*)years?', 1), ''),
    nullif(regexp_extract(text, '(?i)\d+\+?\s*years?'), ''), '3+ years') AS raw FROM pre),
years AS (SELECT job_id, raw[1:50] AS experience_text, CAST(coalesce(nullif(regexp_extract(raw, '{_RANGE}', 1), ''), nullif(regexp_extract(raw, '{_SINGLE}', 1), ''), '3') AS DOUBLE) AS min_years,
  CAST(nullif(regexp_extract(raw, '{_RANGE}', 2), '') AS DOUBLE) AS max_years FROM expt)"""


@query("j08_experience", f"{BASE}, {D_EXP} SELECT * FROM years")
def j08(spark, sf):
    e = jx.experience(jx.experience_text(F.col("text")))
    return _lined(spark, sf).select("job_id", e.alias("e")).select(
        "job_id", F.col("e.raw_text").alias("experience_text"), "e.min_years", "e.max_years")


_EDU = _d_field(r"(?im)^(?:Education qualification|Qualifications - Education|Academic Requirement|Education|Academic)(?::|\s)+([^\n]+)$")
D_EDU = f"""schooling AS (SELECT job_id, coalesce({_EDU}, 'Not specified') AS education FROM pre)"""


@query("j09_education", f"{BASE}, {D_EDU} SELECT * FROM schooling")
def j09(spark, sf):
    return _lined(spark, sf).select("job_id", jx.education(F.col("text")).alias("education"))


_OVER = (r"(?i)(?:Role Overview|Overview)(?::|\s)\s*([\s\S]*?)(?:Key Responsibilities|Responsibilities|Qualifications & Requirements"
         r"|Required Qualifications|Technical Requirements|Technical Skills|Requirements|Skills|Education|$)")
# A sentence ends at . ! ? before white space; the mark is kept by a separator put behind it.
D_SUMMARY = rf"""overviews AS (SELECT job_id, regexp_matches(text, '{_OVER}') AS has, {d_strip(f"regexp_extract(text, '{_OVER}', 1)")} AS o FROM pre),
overview AS (SELECT p.job_id, CASE WHEN has THEN array_to_string(list_filter(string_split(regexp_replace(o, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:5], ' ')
  ELSE coalesce((SELECT string_agg(line, ' ' ORDER BY r) FROM (SELECT job_id, line, row_number() OVER (PARTITION BY job_id ORDER BY n) AS r FROM ln
    WHERE NOT regexp_matches(line, '^(?:Role:|Position Title:|Location:|Company:|Employment Type:|Experience:)')) l WHERE l.job_id = p.job_id AND r <= 3), '') END AS overview
  FROM pre p JOIN overviews USING (job_id))"""


@query("j10_summary", f"{BASE}, {D_SUMMARY} SELECT * FROM overview")
def j10(spark, sf):
    return _lined(spark, sf).select("job_id", jx.summary(F.col("text"), F.col("lines")).alias("overview"))


_REQ_HEADERS = ["Required Qualifications", "Qualifications & Requirements", "Technical Requirements", "Required", "Requirement", "Required Skill", "Key Requirement",
                "Qualification", "What you need", "Skills Required", "Technical Skills", "Skills", "Requirements", "Minimum Qualifications", "Desired Qualifications"]
_REQ_STOPS = ["Preferred Qualifications", "Preferred Skills", "Preferred", "Nice to Have", "Desired Skills", "Secondary Skills", "Certifications", "Certification", "Licenses"]
D_SECTIONS = ", ".join([
    d_section("duty1", "Key Responsibilities", ["Qualifications & Requirements|Required Qualifications"], gate="contains(text, 'Key Responsibilities')"),
    d_section("duty2", "^What you''d actually be doing", ["^(What we mean by|The skills inventory|Things you absolutely need)"]),
    d_section("duty3r", d_headers(jx.DUTY_HEADERS), [], "responsibilities"), f"duty3 AS (SELECT * FROM {d_filled('duty3r')} z)",
    d_first_filled("duties", "duty1", "duty2", "duty3"),
    d_section("req1", "Required Qualifications", ["Preferred Qualifications|$"], "skills", "contains(text, 'Required Qualifications')"),
    d_section("req2", "Technical Requirements", ["Preferred Qualifications|Preferred Skills|Education|$"], "skills",
              "NOT contains(text, 'Required Qualifications') AND NOT contains(text, 'Qualifications & Requirements') AND contains(text, 'Technical Requirements')"),
    d_section("req3r", d_headers(_REQ_HEADERS), [d_headers(_REQ_STOPS)], "skills"), f"req3 AS (SELECT * FROM {d_filled('req3r')} z)",
    d_first_filled("required_lines", "req1", "req2", "req3"),
    d_section("pref1", "Preferred Qualifications", ["Things we explicitly do NOT want|On location|$"], gate="contains(text, 'Preferred Qualifications')"),
    d_section("pref3r", d_headers(jx.PREFERRED_HEADERS), [], "skills"), f"pref3 AS (SELECT * FROM {d_filled('pref3r')} z)",
    d_first_filled("preferred_lines", "pref1", "pref3"),
    d_section("disq_r", "^Things we explicitly do NOT want", ["^(On location|The vibe check|Final note)"]),
    r"disq AS (SELECT * FROM (SELECT job_id, n, " + d_bullets("line") + r" AS line FROM disq_r) x WHERE line <> '' AND NOT regexp_matches(line, '(?i)^(?:this\s+is\s+the\s+section|note:|please\s+note|the\s+following\s+are)\b'))",
    d_section("kpi_r", d_headers(["KPIs", "KPI", "Metrics", "Evaluation Metrics"]), [d_headers(["Disqualifiers", " Vibe"])]), f"kpi AS (SELECT * FROM {d_filled('kpi_r')} z)",
])


@query("j11_sections", f"""{BASE}, {D_SECTIONS} SELECT p.job_id, {d_joined('duties')} AS responsibilities, {d_joined('required_lines')} AS required, {d_joined('preferred_lines')} AS preferred,
{d_joined('disq')} AS disqualifiers, {d_joined('kpi')} AS kpis FROM pre p""")
def j11(spark, sf):
    t, n = F.col("text"), F.col("lines")
    return _lined(spark, sf).select(
        "job_id", _show(jx.responsibilities(t, n)).alias("responsibilities"), _show(jx.requirements(t, n)).alias("required"),
        _show(jx.preferred(t, n)).alias("preferred"), _show(jx.disqualifiers(n)).alias("disqualifiers"), _show(jx.kpis(n)).alias("kpis"))


def d_certs(c: str) -> str:
    forms = []
    for pattern, name in jx.CERT_PATTERNS:
        found = f"nullif(regexp_extract({c}, '(?i){pattern}'), '')"
        if name == "as written":
            forms.append(found)
        elif name == "as code":
            forms.append(f"'Salesforce Administrator (' || upper({found}) || ')'")
        else:
            forms.append(f"CASE WHEN {found} IS NOT NULL THEN '{name}' END")
    general = rf"regexp_replace({d_strip(c)}, '(?i)^(?:e\.g\.|good to have|nice to have|must have|preferred|\s)+', '')"
    general = rf"regexp_replace({general}, '(?i)\s+(?:are\s+a\s+strong\s+plus|is\s+a\s+plus|preferred|required)\.?$', '')"
    general = d_strip(rf"regexp_replace({general}, '^[•*\-\d.\s]+', '')")
    # App Builder has two patterns with one name; a list of distinct names keeps the first.
    named = f"list_filter([{', '.join(forms)}], lambda x: x IS NOT NULL)"
    return rf"""CASE WHEN len({named}) > 0 THEN list_filter({named}, lambda x, i: list_position({named}, x) = i)
      WHEN regexp_matches({c}, '(?i)\b(?:certifications?|certified)\b') AND {general} <> '' AND length({general}) <= 80 THEN [{general}] ELSE [] END"""


@query("j12_certifications", f"{BASE} SELECT * FROM (SELECT job_id, n AS pos, array_to_string({d_certs('line')}, ' | ') AS certifications FROM ln) x WHERE certifications <> ''")
def j12(spark, sf):
    rows = _lined(spark, sf).select("job_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("pos"), _show(
        jx.certifications_in(F.col("line"))).alias("certifications")).filter("certifications <> ''")


_CERTISH = f"regexp_matches({{}}, '(?i)' || {D_CERT_SIGNAL})"
D_CHUNKS = rf"""array_to_string(list_filter(list_transform(list_filter(string_split_regex(line, '[,|;]'), lambda c: NOT {_CERTISH.format('trim(c)')}),
  lambda c: {d_strip(rf"regexp_replace(trim(c), '(?i)^(?:e\.g\.|and|\s)+', '')")}), lambda c: c <> '' AND NOT regexp_matches(lower(c), 'strong plus|added advantage|nice to have|good to have')), ', ')"""


@query("j13_inline_certifications", f"""{BASE} SELECT * FROM (SELECT job_id, n AS pos, {D_CHUNKS} AS rest FROM ln WHERE {_CERTISH.format('line')}) x""")
def j13(spark, sf):
    rows = _lined(spark, sf).select("job_id", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(jx.CERT_RE))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("pos"), F.coalesce(
        jx.without_certifications(F.col("line")), F.lit("")).alias("rest"))


def _parsed(spark, sf):
    return jx.parse_postings(tb.postings(spark, sf))


@query("j14_certification_routing")
def j14(spark, sf):
    return _parsed(spark, sf).select("job_id", _show("requirements").alias("requirements"), _show("preferred_skills").alias("preferred_skills"),
                                     _show("certifications").alias("certifications"))


_PREFIX = jx.HEADER_PREFIX.replace("(?iU)", "(?i)")


def d_tidy(c: str) -> str:
    c = d_strip(f"regexp_replace({d_bullets(c)}, '{_PREFIX}', '')")
    c = d_strip(rf"regexp_replace({c}, '^[:\-]\s*', '')")
    c = d_strip(f"regexp_replace({c}, ':+$', '')")
    return d_editorial(d_strip(rf"regexp_replace({c}, '\.\s*$', '')"))


_LABELS = d_list([*fv.STRUCTURAL_LABELS, "key responsibilities", "but won't reject you for"])
_NOISE = d_list([*fv.NOISE_WORDS, *fv.POSTING_STOPWORDS])
D_NO_CERT = (r"trim(regexp_replace(trim(regexp_replace(regexp_replace(t, '(?i)(?:salesforce\s+)?certifications?\s*\([^)]*\)', '', 'g'),"
             r" '(?i)\b(?:certifications?|certified|cert|certs|pd1|pd2|platform developer\s*(?:i/ii|i|ii|1/2|1|2)?|platform app builder)\b', '', 'g')),"
             r" '(?i)^(?:e\.g\.|good to have|nice to have|must have|preferred|\s|,|\(|\))+', ''))")
_ASCII_T = "regexp_replace(t, '[À-ÖØ-öø-ÿ]', '_', 'g')"
D_CLEAN = rf"""tidy AS (SELECT job_id, n, {d_tidy('line')} AS t FROM ln),
kept AS (SELECT job_id, min(n) AS n, t FROM tidy WHERE t <> '' AND lower(t) NOT IN {_LABELS}
    AND NOT regexp_matches(lower(t), '^(?:but\s+won''t\s+reject\s+you\s+for|nice\s+to\s+have|plusses|bonus|optional)$')
    AND NOT ({_CERTISH.format('t')} AND (length({D_NO_CERT}) < 2 OR lower({D_NO_CERT}) IN {d_list(fv.STRUCTURAL_LABELS)})) AND length(t) BETWEEN 2 AND 300
    AND len(list_filter(regexp_extract_all({_ASCII_T}, '\b[a-zA-Z0-9+#.\-/]+\b'), lambda w: lower(w) NOT IN {_NOISE})) > 0 GROUP BY job_id, t)"""


@query("j15_clean_requirements", f"{BASE}, {D_CLEAN} SELECT p.job_id, coalesce((SELECT string_agg(t, ' | ' ORDER BY n) FROM kept k WHERE k.job_id = p.job_id), '') AS lines FROM pre p")
def j15(spark, sf):
    return _lined(spark, sf).select("job_id", _show(jx.clean_requirements(F.col("lines"))).alias("lines"))


@query("j16_atomic_skill", rf"""{BASE} SELECT job_id, n AS pos, len(string_split_regex(line, '\s+')) BETWEEN 1 AND 3 AND length(line) BETWEEN 2 AND 35 AND NOT regexp_matches(line, '[—–().:;?!,]')
  AND lower(line) NOT IN {d_list([*fv.STRUCTURAL_LABELS, *fv.POSTING_STOPWORDS, *fv.NOISE_WORDS])}
  AND len(list_filter(string_split_regex(lower(line), '\s+'), lambda w: w IN {d_list(fv.SENTENCE_WORDS)})) = 0 AS atomic FROM ln""")
def j16(spark, sf):
    rows = _lined(spark, sf).select("job_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("job_id", (F.col("pos") + 1).cast("long").alias("pos"), jx.is_atomic_skill(F.col("line")).alias("atomic"))


@query("j17_ontology_tags")
def j17(spark, sf):
    out = _parsed(spark, sf)
    return out.select("job_id", _show("technical_skills").alias("technical_skills"), *[
        _show(c).alias(c) for c in fv.ONTOLOGY if c != "certifications"], _show("nice_to_have").alias("nice_to_have"))


D_KEYWORDS = rf"""words AS (SELECT DISTINCT job_id, regexp_replace(lower(w), '^{_P}+|{_P}+$', '', 'g') AS w FROM (
  SELECT job_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g'), '\b[a-zA-Z0-9./-]+\b')) AS w FROM pre) x)"""


@query("j18_keywords", rf"""{BASE}, {D_KEYWORDS} SELECT p.job_id, coalesce((SELECT string_agg(w, ' ' ORDER BY w) FROM words k WHERE k.job_id = p.job_id AND length(w) >= 2 AND w NOT IN {_NOISE}
  AND NOT regexp_matches(w, '^\d+\.?\d*$')), '') AS keywords FROM pre p""")
def j18(spark, sf):
    return _lined(spark, sf).select("job_id", F.array_join(jx.keywords(F.col("text")), " ").alias("keywords"))


@query("j19_logistics", rf"""{BASE} SELECT job_id, CASE WHEN regexp_matches(text, '(?i)\bremote\b') THEN 'Remote' WHEN regexp_matches(text, '(?i)\bhybrid\b') THEN 'Hybrid'
  WHEN regexp_matches(text, '(?i)\bon-site\b|\bon site\b') THEN 'On-site' ELSE 'Not specified' END AS work_mode,
  CASE WHEN NOT regexp_matches(text, '(?i)\brelocation\b|\brelocate\b') THEN 'Not specified' WHEN regexp_matches(text, '(?i)\bno relocation\b|\bnot open to relocation\b') THEN 'No' ELSE 'Yes' END AS relocation,
  coalesce({_d_field(r'(?i)(?:notice period|notice):\s*([^\n.]*)')}, 'Not specified') AS notice_preference,
  coalesce({_d_field(r'(?i)(?:salary|compensation|lpa):\s*([^\n.]*)')}, 'Not specified') AS salary FROM pre""")
def j19(spark, sf):
    t = F.col("text")
    return _lined(spark, sf).select("job_id", jx.work_mode(t).alias("work_mode"), jx.relocation(t).alias("relocation"),
                                    jx.notice_preference(t).alias("notice_preference"), jx.salary(t).alias("salary"))


@query("j20_recruiter_summary")
def j20(spark, sf):
    return _parsed(spark, sf).select("job_id", "summary")


@query("j21_warnings")
def j21(spark, sf):
    return _parsed(spark, sf).select("job_id", "low_confidence", _show("warnings").alias("warnings"))
