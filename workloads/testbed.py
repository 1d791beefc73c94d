"""Candidate-, posting- and application-shaped tables derived from the given tables.

The flat tables are plain SQL over the given tables, using only what Spark and the
checking engine read alike (key arithmetic, CASE, concatenation). The Spark side nests
them into the candidate schema; the checking SQL reads the flat form directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SKILL_NAMES = [
    "Python", "FastAPI", "Docker", "Kubernetes", "PyTorch", "TensorFlow", "FAISS", "Pinecone",
    "Milvus", "Qdrant", "ChromaDB", "Elasticsearch", "OpenSearch", "BM25",
    "Sentence Transformers", "BERT", "LoRA", "QLoRA", "PEFT", "RAG", "LLM", "NLP",
    "Machine Learning", "Deep Learning", "Computer Vision", "SQL", "PostgreSQL", "MySQL",
    "MongoDB", "AWS", "Azure", "GCP", "React", "Angular", "JavaScript", "TypeScript", "HTML",
    "CSS", "Java", "Spring Boot", "Salesforce", "Salesforce CRM", "Service Cloud", "Go", "C++",
    "Data Science", "Semantic Search", "Vector Search", "python3", "  Docker  ",
    "Recommendation Engine", "golang", "k8s", "Next.js", "sentence-transformers",
    "Large Language Models", "BGE-large", "retrieval augmented generation", "Analytics", "MLOps",
]
N_SKILL_SLOTS = 160

JOB_TITLES = [
    "Senior AI Engineer", "Machine Learning Engineer", "Backend Developer", "Data Analyst",
    "Principal Architect", "Search Engineer", "Salesforce Developer", "DevOps Lead",
    "NLP Researcher", "Full Stack Developer", "Engineering Manager", "Python Developer",
]
COMPANIES = [
    "Google", "Acme Corp", "NVIDIA", "Globex", "Initech", "OpenAI", "Umbrella Labs", "Scale AI",
    "Hooli", "Stark Industries", "Microsoft India", "Unknown", "Wayne Tech",
]
DESCRIPTIONS = [
    "Built a Python retrieval pipeline serving 20 million users. Improved latency by 35%",
    "Maintained internal dashboards and reports. Helped the team with planning",
    "Deployed FAISS and BM25 search in production; reduced cost of queries",
    "Designed distributed training jobs with PyTorch. Mentored juniors on docker",
    "Owned elasticsearch clusters at scale. Optimize throughput for the ranking service",
    "Wrote documentation for customers and partners across regions",
    "Led migration to kubernetes and aws with an a/b test for every release",
]
FIELDS = [
    "Computer Science", "Mechanical Engineering", "History", "Information Technology",
    "Applied Statistics", "Fine Arts", "Business Administration",
]
DEGREES = [
    "B.Tech", "Master of Science", "PhD", "Bachelor of Arts", "MBA", "High School Diploma",
    "M.Tech", "Doctor of Philosophy",
]
CERT_NAMES = [
    "PD1", "AWS Certified Solutions Architect", "Salesforce Administrator", "ADM-201",
    "Salesforce Platform Developer I", "Platform App Builder", "Scrum Master",
]
LEVELS = ["expert", "advanced", "intermediate", "beginner", "Lead"]
MODES = ["remote", "hybrid", "onsite", "unknown", "Flexible"]
REQUIRED_LINES = [
    "Python", "Production experience with vector databases - Pinecone, Qdrant or FAISS",
    "Machine Learning", "Kubernetes", "Salesforce CRM/PRM Modules", "elasticsearch",
    "Salesforce Platform Developer I", "Hands-on work with LoRA, QLoRA and PEFT tuning",
    "Sentence Transformers", "React", "AI", "PostgreSQL", "Docker & AWS deployment",
    "Strong communication and go getter attitude", "Lightning Aura, LWC, HTML, CSS, JavaScript",
    "Recommender Systems", "C++", "Salesforce Service Cloud Sales Cloud", "Next.js",
    "Semantic Search", "ML", "Search Engineer",
]
PREFERRED_LINES = [
    "Go", "Deep Learning", "GCP", "None specified", "Angular", "PD1 Certification", "NLP",
    "Vector databases", "Not specified", "BERT", "Experience with MySQL or MongoDB",
]
TECH_SKILL_NAMES = [
    "Python", "FAISS", "Pinecone", "Qdrant", "LoRA", "QLoRA", "PEFT", "Docker", "AWS",
    "Machine Learning", "PostgreSQL", "JavaScript", "Sentence Transformers", "production", "Go",
]


def pick(key: str, values: list[str]) -> str:
    """SQL that picks a list entry by an integer expression."""
    quoted = [v.replace("'", "''") for v in values]
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted))
    return f"CASE CAST(({key}) % {len(values)} AS INT) {arms} END"


def _times(n: int, body: str) -> str:
    """UNION ALL of ``body`` with ``$i`` set to 0..n-1."""
    return " UNION ALL ".join(body.replace("$i", str(i)) for i in range(n))


# At least seven digits; longer keys keep all of theirs.
CANDIDATE_ID = ("'CAND_' || lpad(CAST({key} AS STRING), CAST(greatest(length(CAST({key} AS STRING)), 7) AS INT), '0')")


def cid(key: str) -> str:
    return CANDIDATE_ID.replace("{key}", key)


FLAT_SQL = {
    # one row per candidate: profile and activity signals
    "cand": f"""
        SELECT {cid('c.c_custkey')} AS candidate_id, c.c_custkey AS custkey,
          '  Person   ' || CAST(CAST(floor(c.c_custkey / 3.0) AS BIGINT) % 40 AS STRING) || ' ' AS name,
          CASE WHEN c.c_custkey % 11 = 0 THEN 'PhD ' ELSE '' END
            || {pick('c.c_custkey', JOB_TITLES)} || '  with passion' AS headline,
          CASE WHEN c.c_custkey % 17 = 0 THEN '  ' ELSE coalesce(d.text, '') END AS summary,
          CASE WHEN c.c_custkey % 19 = 0 THEN '' ELSE 'City ' || CAST(c.c_nationkey AS STRING) END AS location,
          coalesce(n.n_name, '') AS country,
          CAST(CAST(floor(c.c_custkey / 7.0) AS BIGINT) % 37 AS DOUBLE) / 2 AS years,
          CASE WHEN c.c_custkey % 23 = 0 THEN '' ELSE {pick('floor(c.c_custkey / 5.0)', JOB_TITLES)} END AS title,
          CASE WHEN c.c_custkey % 31 = 0 THEN '' ELSE {pick('c.c_custkey', COMPANIES)} END AS company,
          CAST(40 + c.c_custkey % 61 AS DOUBLE) AS completeness,
          '2024-' || CAST(1 + c.c_custkey % 12 AS STRING) || '-15' AS signup_date,
          CASE WHEN c.c_custkey % 37 = 0 THEN 'never'
               ELSE CAST(2024 + CASE WHEN c.c_custkey % 29 = 0 THEN -1 ELSE 1 + c.c_custkey % 2 END AS STRING)
                 || '-06-0' || CAST(1 + c.c_custkey % 9 AS STRING) END AS last_active_date,
          c.c_custkey % 3 = 0 AS open_to_work,
          CAST(coalesce(e.n_view, 0) AS BIGINT) AS profile_views,
          CAST(coalesce(e.n_purchase, 0) AS BIGINT) AS applications,
          CASE WHEN e.n_all IS NULL THEN CAST(0 AS DOUBLE)
               ELSE least(CAST(1 AS DOUBLE), CAST(4 * e.n_click AS DOUBLE) / e.n_all) END AS response_rate,
          CAST(c.c_custkey % 72 AS DOUBLE) AS response_hours,
          CAST(c.c_custkey * 13 % 700 AS BIGINT) AS connections,
          CAST(c.c_custkey * 7 % 400 AS BIGINT) AS endorsements_received,
          CAST(CASE c.c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 30 WHEN 3 THEN 45
               WHEN 4 THEN 60 WHEN 5 THEN 90 ELSE 120 END AS BIGINT) AS notice_days,
          CAST(c.c_custkey % 12 AS DOUBLE) AS salary_min,
          greatest(CAST(0 AS DOUBLE), c.c_acctbal / 100) AS salary_max,
          {pick('c.c_custkey', MODES)} AS work_mode,
          c.c_custkey % 2 = 0 AS willing_to_relocate,
          CAST(c.c_custkey % 102 - 1 AS DOUBLE) AS github_score,
          CASE WHEN e.n_all IS NULL THEN CAST(0 AS DOUBLE)
               ELSE CAST(e.n_signup AS DOUBLE) / e.n_all END AS interview_rate,
          CAST(c.c_custkey % 3 - 1 AS DOUBLE) AS offer_rate,
          c.c_custkey % 4 <> 0 AS verified_email, c.c_custkey % 5 <> 0 AS verified_phone,
          c.c_custkey % 6 <> 0 AS linkedin
        FROM (SELECT c_custkey, c_nationkey, c_acctbal,
            c_custkey % (SELECT max(doc_id) + 1 FROM {{documents}}) AS doc_key,
            c_custkey % (SELECT max(user_id) + 1 FROM {{events}}) AS user_key FROM {{customer}}) c
        LEFT JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN {{documents}} d ON d.doc_id = c.doc_key
        LEFT JOIN (SELECT user_id, count(*) AS n_all,
            sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n_click,
            sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS n_view,
            sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS n_purchase,
            sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS n_signup
          FROM {{events}} GROUP BY user_id) e
          ON e.user_id = c.user_key""",
    # skills of a candidate in list order
    "cand_skill": f"""
        SELECT {cid('custkey')} AS candidate_id,
          CAST(row_number() OVER (PARTITION BY custkey ORDER BY first_order, slot) AS BIGINT) AS pos,
          CASE WHEN slot < {len(SKILL_NAMES)} THEN {pick('slot', SKILL_NAMES)}
               ELSE 'Tool ' || CAST(slot AS STRING) END AS name,
          {pick('lvl', LEVELS)} AS proficiency, endorsements,
          CASE WHEN (custkey + slot) % 41 = 0 THEN NULL ELSE months END AS months
        FROM (SELECT o.o_custkey AS custkey, l.l_partkey % {N_SKILL_SLOTS} AS slot,
                min(l.l_orderkey) AS first_order, CAST(count(*) AS BIGINT) AS endorsements,
                CAST(max(l.l_linenumber) AS BIGINT) AS lvl,
                CAST(sum(l.l_quantity) AS BIGINT) % 150 AS months
              FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey
              GROUP BY o.o_custkey, l.l_partkey % {N_SKILL_SLOTS}) s""",
    # jobs of a candidate, most recent first
    "cand_job": f"""
        SELECT candidate_id, pos, company, title, start_date,
          CASE WHEN pos = 1 THEN NULL ELSE end_date END AS end_date,
          months, pos = 1 AS is_current, industry, description
        FROM (SELECT {cid('o.o_custkey')} AS candidate_id,
            CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey) AS BIGINT) AS pos,
            {pick('floor(o.o_orderkey / 2.0)', COMPANIES)} AS company,
            {pick('o.o_orderkey', JOB_TITLES)} AS title,
            CASE WHEN o.o_orderkey % 211 = 0 THEN 'unknown'
                 ELSE CAST(CAST(o.o_orderdate AS DATE) + CAST(CASE WHEN o.o_orderkey % 389 = 0 THEN 12500
                   ELSE 8800 END AS INT) AS STRING) END AS start_date,
            CAST(CAST(o.o_orderdate AS DATE) + CAST(8800 + CASE WHEN o.o_orderkey % 197 = 0 THEN -30
              ELSE o.o_orderkey % 150 END AS INT) AS STRING) AS end_date,
            CAST(CASE WHEN o.o_orderkey % 53 = 0 THEN 60 + o.o_orderkey % 90
              ELSE o.o_orderkey % 14 END AS BIGINT) AS months,
            o.o_orderpriority AS industry,
            {pick('o.o_orderkey', DESCRIPTIONS)} || '. Handled ' || CAST(o.o_orderkey % 50 AS STRING)
              || ' tickets for ' || o.o_orderstatus AS description
          FROM {{orders}} o) j""",
    "cand_edu": f"""
        SELECT {cid('c.c_custkey')} AS candidate_id, CAST(1 AS BIGINT) AS pos,
          n.n_name || ' University ' AS institution, {pick('c.c_custkey', DEGREES)} AS degree,
          {pick('c.c_custkey', FIELDS)} AS field, CAST(2005 + c.c_custkey % 9 AS BIGINT) AS start_year,
          CAST(2008 + c.c_custkey % 9 - CASE WHEN c.c_custkey % 43 = 0 THEN 5 ELSE 0 END AS BIGINT) AS end_year,
          'tier_' || CAST(1 + c.c_custkey % 3 AS STRING) AS tier
        FROM {{customer}} c JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
        UNION ALL
        SELECT {cid('c.c_custkey')}, CAST(2 AS BIGINT),
          CASE WHEN c.c_custkey % 8 = 0 THEN 'Unknown' ELSE n.n_name || ' School' END,
          {pick('floor(c.c_custkey / 8.0)', DEGREES)}, {pick('floor(c.c_custkey / 7.0)', FIELDS)},
          CAST(2001 + c.c_custkey % 12 AS BIGINT), CAST(2003 + c.c_custkey % 12 AS BIGINT),
          'tier_' || CAST(1 + c.c_custkey % 4 AS STRING)
        FROM {{customer}} c JOIN {{nation}} n ON n.n_nationkey = (c.c_nationkey + 3) % 25
        WHERE c.c_custkey % 5 <> 0""",
    "cand_cert": f"""
        SELECT {cid('c.c_custkey')} AS candidate_id, CAST(1 AS BIGINT) AS pos,
          {pick('c.c_custkey', CERT_NAMES)} AS name, 'Issuer ' || c.c_mktsegment AS issuer,
          CAST(2015 + c.c_custkey % 10 AS BIGINT) AS year
        FROM {{customer}} c WHERE c.c_custkey % 3 <> 1
        UNION ALL
        SELECT {cid('c.c_custkey')}, CAST(2 AS BIGINT), {pick('c.c_custkey + 3', CERT_NAMES)},
          'Issuer ' || c.c_mktsegment, CAST(2018 + c.c_custkey % 5 AS BIGINT)
        FROM {{customer}} c WHERE c.c_custkey % 6 = 2""",
    # job postings in parsed form
    "job": f"""
        SELECT s.s_suppkey AS job_id, {pick('s.s_suppkey', JOB_TITLES)} AS title,
          'Hiring at ' || s.s_name || ' for ' || {pick('s.s_suppkey', COMPANIES)} AS summary,
          CAST(s.s_suppkey % 9 AS DOUBLE) AS min_years
        FROM {{supplier}} s""",
    "job_line": f"""
        SELECT job_id, idx, kind, line FROM (
          {_times(4, f'''SELECT s.s_suppkey AS job_id, CAST($i AS BIGINT) AS idx, 'required' AS kind,
            {pick('s.s_suppkey * 3 + $i * 5', REQUIRED_LINES)} AS line FROM {{{{supplier}}}} s''')}
          UNION ALL
          {_times(3, f'''SELECT s.s_suppkey, CAST(4 + $i AS BIGINT), 'preferred',
            {pick('s.s_suppkey + $i * 4', PREFERRED_LINES)} FROM {{{{supplier}}}} s''')}) x""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "job_tech": f"""
        {_times(6, f'''SELECT s.s_suppkey AS job_id, CAST($i AS BIGINT) AS idx,
          {pick('s.s_suppkey + $i * 2', TECH_SKILL_NAMES)} AS name FROM {{{{supplier}}}} s''')}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    # who applies where; posting 0 draws a third of all candidates
    "application": f"""
        SELECT CASE WHEN c.c_custkey % 3 = 0 THEN CAST(0 AS BIGINT)
                 ELSE c.c_custkey % (SELECT max(s_suppkey) + 1 FROM {{supplier}}) END AS job_id,
          {cid('c.c_custkey')} AS candidate_id
        FROM {{customer}} c""",
    # raw posting text around each document
    "posting": f"""
        SELECT d.doc_id AS job_id,
          CASE d.doc_id % 4
            WHEN 0 THEN 'Job Title: ' || {pick('d.doc_id', JOB_TITLES)} || chr(10)
            WHEN 1 THEN '# Role ' || {pick('d.doc_id', JOB_TITLES)} || '- 5+Yrs' || chr(10)
            WHEN 2 THEN 'We are looking for a ' || {pick('d.doc_id', JOB_TITLES)} || ' to join us.' || chr(10)
            ELSE 'Overview' || chr(10) || {pick('d.doc_id', JOB_TITLES)} || chr(10) END
          || CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'Company: ' || {pick('d.doc_id', COMPANIES)} || chr(10) END
          || CASE d.doc_id % 3 WHEN 0 THEN 'Location: Pune' || chr(10)
               WHEN 1 THEN 'Location' || chr(10) || 'Hyderabad, India' || chr(10) ELSE '' END
          || CASE WHEN d.doc_id % 2 = 0 THEN 'Employment Type: Full-time' || chr(10) ELSE '' END
          || CASE d.doc_id % 5 WHEN 0 THEN 'Experience Required: ' || CAST(2 + d.doc_id % 5 AS STRING) || '-'
                   || CAST(6 + d.doc_id % 7 AS STRING) || ' years' || chr(10)
               WHEN 1 THEN 'Experience Required: minimum ' || CAST(1 + d.doc_id % 8 AS STRING) || '+ years' || chr(10)
               WHEN 2 THEN 'Experience' || chr(10) || '4 to 7 years in the field' || chr(10)
               ELSE '' END
          || CASE WHEN d.doc_id % 6 = 5 THEN '' ELSE 'Role Overview:' || chr(10) END
          || d.text || chr(10)
          || CASE WHEN d.doc_id % 7 = 3 THEN '' ELSE
               CASE WHEN d.doc_id % 2 = 0 THEN 'Technical Requirements:' ELSE 'Required Qualifications:' END
               || chr(10) || '- ' || {pick('d.doc_id', REQUIRED_LINES)} || chr(10)
               || '* ' || {pick('d.doc_id + 7', REQUIRED_LINES)} || chr(10)
               || '1. ' || {pick('d.doc_id * 2 + 3', REQUIRED_LINES)} || '. We don''t care which one.' || chr(10)
               || 'Good to have PD1 certification, Visualforce' || chr(10) END
          || CASE WHEN d.doc_id % 4 = 1 THEN '' ELSE
               'Preferred Skills:' || chr(10) || '- ' || {pick('d.doc_id', PREFERRED_LINES)} || chr(10)
               || '- ' || {pick('d.doc_id + 5', PREFERRED_LINES)} || chr(10) END
          || CASE WHEN d.doc_id % 3 = 2 THEN '' ELSE 'Key Responsibilities' || chr(10)
               || '- ' || {pick('d.doc_id', DESCRIPTIONS)} || chr(10)
               || '- Own the roadmap' || chr(10) END
          || CASE WHEN d.doc_id % 8 = 0 THEN 'Things we explicitly do NOT want' || chr(10)
               || 'Note: read this' || chr(10) || '- Title-chasers' || chr(10) ELSE '' END
          || CASE WHEN d.doc_id % 2 = 0 THEN 'Education:' || chr(10) || {pick('d.doc_id', DEGREES)}
               || ' in ' || {pick('d.doc_id', FIELDS)} || chr(10) ELSE '' END
          || CASE WHEN d.doc_id % 5 = 2 THEN 'Certifications' || chr(10)
               || {pick('d.doc_id', CERT_NAMES)} || chr(10) ELSE '' END
          || CASE WHEN d.doc_id % 9 = 4 THEN 'KPIs' || chr(10) || 'Precision at 10' || chr(10) ELSE '' END
          || CASE d.doc_id % 4 WHEN 0 THEN 'Remote work, relocation offered' || chr(10)
               WHEN 1 THEN 'Hybrid, no relocation' || chr(10) WHEN 2 THEN 'On-site' || chr(10) ELSE '' END
          || CASE WHEN d.doc_id % 3 = 0 THEN 'Notice period: 30 days. Salary: 20 LPA' || chr(10) ELSE '' END
          AS raw_text
        FROM {{documents}} d""",
    # stored results of a run: scores and lists by key arithmetic, the list cut at 100
    "result": f"""
        SELECT * FROM (SELECT r.*, CAST(row_number() OVER (PARTITION BY job_id
            ORDER BY final_score DESC, behavior_score DESC, candidate_id) AS BIGINT) AS rank FROM (
          SELECT CASE WHEN c.c_custkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE c.c_custkey % (SELECT max(s_suppkey) + 1 FROM {{supplier}}) END AS job_id,
            {cid('c.c_custkey')} AS candidate_id, c.c_custkey AS custkey,
            CAST(c.c_custkey * 37 % 1010 AS DOUBLE) / 10 AS final_score, CAST(c.c_custkey % 41 AS DOUBLE) AS skill_score,
            CAST(c.c_custkey % 26 AS DOUBLE) AS experience_score, CAST(c.c_custkey % 11 AS DOUBLE) AS education_score,
            CAST(c.c_custkey % 9 AS DOUBLE) AS project_score, CAST(c.c_custkey * 7 % 10 AS DOUBLE) AS behavior_score,
            CAST(c.c_custkey % 6 AS DOUBLE) AS availability_score, CAST(c.c_custkey % 3 AS DOUBLE) / 4 AS engagement_bonus,
            c.c_custkey % 13 = 0 AS is_honeypot
          FROM {{customer}} c) r) q
        WHERE rank <= 100""",
    # the same list as it might have been handed in, with faults
    "handed_in": f"""
        SELECT job_id, row_num, CASE WHEN (row_num + job_id) % 53 = 7 THEN CAST(3 AS BIGINT) ELSE CAST(4 AS BIGINT) END AS n_cells,
          CASE WHEN (row_num + job_id) % 31 = 3 THEN '' WHEN (row_num + job_id) % 37 = 5 THEN 'C_' || candidate_id
               WHEN (row_num + job_id) % 41 = 6 THEN '{'CAND_0000001'}' ELSE candidate_id END AS candidate_id,
          CASE WHEN (row_num + job_id) % 29 = 1 THEN '0' || CAST(row_num AS STRING) WHEN (row_num + job_id) % 43 = 2 THEN '101'
               WHEN (row_num + job_id) % 47 = 4 THEN '2' ELSE ' ' || CAST(row_num AS STRING) END AS rank,
          CASE WHEN (row_num + job_id) % 59 = 8 THEN 'high' WHEN (row_num + job_id) % 17 = 9 THEN '1e2'
               ELSE CAST(score AS STRING) END AS score
        FROM (SELECT CASE WHEN c.c_custkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE c.c_custkey % (SELECT max(s_suppkey) + 1 FROM {{supplier}}) END AS job_id,
            {cid('c.c_custkey')} AS candidate_id, CAST(c.c_custkey * 37 % 101 AS BIGINT) AS score,
            CAST(row_number() OVER (PARTITION BY CASE WHEN c.c_custkey % 3 = 0 THEN 0 ELSE c.c_custkey % (SELECT max(s_suppkey) + 1 FROM {{supplier}}) END
              ORDER BY c.c_custkey * 37 % 101 DESC, c.c_custkey) AS BIGINT) AS row_num
          FROM {{customer}} c) x""",
}
FLAT_SQL = {name: sql.replace("{{", "{").replace("}}", "}") for name, sql in FLAT_SQL.items()}


_LOADED: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is read once per session."""
    path = f"{sf_dir}/{table}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _LOADED:
        _LOADED[key] = spark.read.parquet(path)
    return _LOADED[key]


def flat(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FLAT_SQL[name]
    frames = {t: load(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **frames)


def with_flat(*names: str) -> str:
    """The same flat tables as common table expressions for the checking SQL."""
    parts = []
    for name in names:
        sql = FLAT_SQL[name]
        for table in BASE_TABLES:
            sql = sql.replace("{" + table + "}", table)
        parts.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"


def _nest(df: DataFrame, fields: str, name: str) -> DataFrame:
    """Rows of a candidate as an array of structs in list order."""
    item = F.struct(F.col("pos"), F.expr(f"struct({fields}) AS item"))
    ordered = F.sort_array(F.collect_list(item))
    return df.groupBy("candidate_id").agg(
        F.transform(ordered, lambda x: x["item"]).alias(name))


_PARTS = {
    "career_history": ("cand_job", "company, title, start_date, end_date, cast(months as int) AS duration_months, "
                       "is_current, industry, '51-200' AS company_size, description"),
    "education": ("cand_edu", "institution, degree, field AS field_of_study, cast(start_year as int) AS start_year, "
                  "cast(end_year as int) AS end_year, cast(null as string) AS grade, tier"),
    "skills": ("cand_skill", "name, proficiency, cast(endorsements as int) AS endorsements, "
               "cast(months as int) AS duration_months"),
    "certifications": ("cand_cert", "name, issuer, cast(year as int) AS year"),
}
_REQUIRED_PARTS = {"career_history", "education", "skills"}


def candidates(
    spark: SparkSession, sf_dir: str,
    parts: tuple[str, ...] = ("career_history", "education", "skills", "certifications"),
) -> DataFrame:
    """Nested candidates with the array columns a query needs.

    Dealt by id into as many partitions as the session names, which the joins keep: small rows
    would be put together into one task, yet the text work on them is not small.
    """
    from candisieve.sources.candidates import CANDIDATE_SCHEMA

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = flat(spark, sf_dir, "cand").selectExpr(
        "candidate_id",
        """struct(name AS anonymized_name, headline, summary, location, country,
             years AS years_of_experience, title AS current_title, company AS current_company,
             '51-200' AS current_company_size, 'Software' AS current_industry) AS profile""",
        """struct(completeness AS profile_completeness_score, signup_date, last_active_date,
             open_to_work AS open_to_work_flag, cast(profile_views AS int) AS profile_views_received_30d,
             cast(applications AS int) AS applications_submitted_30d,
             response_rate AS recruiter_response_rate, response_hours AS avg_response_time_hours,
             map('Python', completeness) AS skill_assessment_scores,
             cast(connections AS int) AS connection_count,
             cast(endorsements_received AS int) AS endorsements_received,
             cast(notice_days AS int) AS notice_period_days,
             struct(salary_min AS min, salary_max AS max) AS expected_salary_range_inr_lpa,
             work_mode AS preferred_work_mode, willing_to_relocate,
             github_score AS github_activity_score, cast(profile_views AS int) AS search_appearance_30d,
             cast(applications AS int) AS saved_by_recruiters_30d,
             interview_rate AS interview_completion_rate, offer_rate AS offer_acceptance_rate,
             verified_email, verified_phone, linkedin AS linkedin_connected) AS signals""")
    out = base.repartition(n, "candidate_id")
    for part in parts:
        table, fields = _PARTS[part]
        out = out.join(_nest(flat(spark, sf_dir, table), fields, part), "candidate_id", "left")
    columns = []
    for field in CANDIDATE_SCHEMA.fields:
        kind = field.dataType
        # No cast where the column exists: its types already are those of the schema, and
        # a cast of a whole struct would hide its fields from the optimiser.
        if field.name in parts and field.name in _REQUIRED_PARTS:
            value = F.coalesce(F.col(field.name), F.array().cast(kind))
        elif field.name in out.columns:
            value = F.col(field.name)
        elif field.name in _REQUIRED_PARTS:
            value = F.array().cast(kind)
        else:
            value = F.lit(None).cast(kind)
        columns.append(value.alias(field.name))
    return out.select(*columns)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed postings: one row per job with its requirement lists.

    Dealt by id once they are whole: what is told from a posting takes far longer than reading it,
    and the small rows of the joins would be put together into one task. By a hash of the id, as
    Spark drops a shuffle by the id alone in favour of the one that a join by it asks for.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = flat(spark, sf_dir, "job_line").groupBy("job_id").agg(
        F.expr("transform(sort_array(collect_list(CASE WHEN kind = 'required' THEN struct(idx, line) END)), x -> x.line)")
        .alias("requirements"),
        F.expr("transform(sort_array(collect_list(CASE WHEN kind = 'preferred' THEN struct(idx, line) END)), x -> x.line)")
        .alias("preferred_skills"))
    tech = flat(spark, sf_dir, "job_tech").groupBy("job_id").agg(
        F.expr("transform(sort_array(collect_list(struct(idx, name))), x -> x.name)").alias("technical_skills"))
    return (
        flat(spark, sf_dir, "job").join(lines, "job_id").join(tech, "job_id").repartition(n, F.xxhash64("job_id"))
        .withColumn("keywords", F.expr(
            "array_sort(array_distinct(flatten(transform(technical_skills, t -> split(lower(t), ' ')))))")))


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "application")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw postings, spread evenly: reading them is cheap, parsing them is not."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return flat(spark, sf_dir, "posting").repartition(n, "job_id")


# Which list a requirement line of a stored result stands in.
_LISTS = {
    "critical_skills_matched": "l.kind = 'required' AND (r.custkey + l.idx) % 4 = 0",
    "important_skills_matched": "l.kind = 'required' AND (r.custkey + l.idx) % 4 = 1",
    "nice_to_have_skills_matched": "l.kind = 'preferred' AND (r.custkey + l.idx) % 2 = 0",
    "missing_critical_skills": "l.kind = 'required' AND (r.custkey + l.idx) % 4 = 2",
    "matched_skills": "l.kind = 'required' AND (r.custkey + l.idx) % 4 <= 1",
    "missing_skills": "(r.custkey + l.idx) % 4 >= 2",
}
_LINE = "l.line || CASE WHEN (r.custkey + l.idx) % 5 = 0 THEN ' (via Python)' ELSE '' END"


def results(spark: SparkSession, sf_dir: str, profile: bool = True) -> DataFrame:
    """Stored results with their lists and display fields."""
    from candisieve.operators.profile import build_profile

    r, lines = flat(spark, sf_dir, "result"), flat(spark, sf_dir, "job_line")
    lists = [
        f"transform(sort_array(collect_list(CASE WHEN {test} THEN struct(l.idx, {_LINE} AS line) END)), x -> x.line) AS {name}"
        for name, test in _LISTS.items()]
    grouped = spark.sql(f"""SELECT r.job_id, r.candidate_id, {", ".join(lists)},
        transform(sort_array(collect_list(CASE WHEN l.kind = 'required' THEN struct(l.idx, l.line) END)), x -> x.line) AS requirements,
        transform(sort_array(collect_list(CASE WHEN l.kind = 'preferred' THEN struct(l.idx, l.line) END)), x -> x.line) AS preferred_skills
      FROM {{r}} r JOIN {{l}} l ON l.job_id = r.job_id GROUP BY r.job_id, r.candidate_id""", r=r, l=lines)
    out = r.drop("custkey").join(grouped, ["job_id", "candidate_id"])
    if not profile:
        return out
    cand = build_profile(candidates(spark, sf_dir)).select(
        "candidate_id", "name", "headline", "summary", "current_title", "current_company", "years_of_experience",
        "location", "open_to_work", F.col("notice_period_days").cast("long").alias("notice_period_days"),
        F.transform("skills", lambda s: s["name"]).alias("skills"), F.col("skills").alias("skill_items"),
        "career_history", "education", "certifications",
        F.col("signals.recruiter_response_rate").alias("recruiter_response_rate"))
    job = flat(spark, sf_dir, "job").select("job_id", F.col("title").alias("job_title"))
    return out.join(cand, "candidate_id").join(job, "job_id").withColumn(
        "reasoning", F.concat(F.lit("Ranked "), F.col("rank").cast("string")))


def d_results(*more: str) -> str:
    """The same as flat tables for the checking SQL: ``result``, ``entry`` (one row per
    list entry) and ``res`` (result with display fields)."""
    names = ["result", "job_line", "job", "cand", *more]
    entry = " UNION ALL ".join(
        f"SELECT r.job_id, r.candidate_id, '{name}' AS list, l.idx, {_LINE} AS line FROM result r JOIN job_line l ON l.job_id = r.job_id WHERE {test}"
        for name, test in _LISTS.items())
    return with_flat(*dict.fromkeys(names)).rstrip() + f""",
entry AS (SELECT *, trim(string_split(line, ' (via')[1]) AS clean FROM ({entry}) e),
res AS (SELECT r.*, trim(regexp_replace(c.name, '\\s+', ' ', 'g')) AS name, c.title AS current_title, c.company AS current_company, c.years,
    trim(regexp_replace(concat_ws(', ', nullif(c.location, ''), nullif(c.country, '')), '\\s+', ' ', 'g')) AS location,
    c.open_to_work, c.notice_days, c.response_rate, c.summary, c.headline, j.title AS job_title, 'Ranked ' || r.rank AS reasoning
  FROM result r JOIN cand c USING (candidate_id) JOIN job j ON j.job_id = r.job_id)
"""
