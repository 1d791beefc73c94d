"""S01-S16 and R13."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.operators import retrieval as rt
from candisieve.plans.funnel import FUNNEL_SIZES, bm25_stage, funnel, lexical_stage
from candisieve.session import materialize, scratch_path
from candisieve.sources import candidates as sc
from candisieve.sources import postings as sp
from candisieve.sources import results as sr
from candisieve.sources.synonyms import parse_synonyms
from workloads import testbed as tb
from workloads.profile_queries import D_BM25_TEXT, d_term_tokens
from workloads.registry import d_list, d_norm, query
from workloads.retrieval_queries import STOP, _docs, _load_text_statistics
from workloads.scoring_queries import cand_vectors, job_vectors
from workloads.skill_queries import synonyms

SCHEMA = {"required": ["candidate_id", "profile", "career_history", "education", "skills", "signals"],
          "properties": {"profile": {"required": ["headline", "summary", "current_title", "years_of_experience"]}}}


def candidate_lines(spark, sf):
    """Candidates as JSON lines, some spoilt: no JSON, blank, bad id, years out of range,
    a missing root key, a number written as text."""
    c = tb.candidates(spark, sf)
    names = sc.CANDIDATE_SCHEMA.fieldNames()
    key = F.substr("candidate_id", F.lit(6)).cast("long") % 20
    json = F.to_json(F.struct(*names))
    value = (
        F.when(key == 0, "invalid json string").when(key == 1, "  ")
        .when(key == 3, F.regexp_replace(json, '"candidate_id":"CAND_', '"candidate_id":"BAD_'))
        .when(key == 4, F.regexp_replace(json, r'"years_of_experience":[0-9.]+', '"years_of_experience":99.0'))
        .when(key == 5, F.regexp_replace(json, '"signals":', '"other":'))
        .when(key == 6, F.regexp_replace(json, r'"years_of_experience":[0-9.]+', '"years_of_experience":"7"'))
        .otherwise(json))
    return c.select(value.alias("value"))


CAND = tb.with_flat("cand")
K = "custkey % 20"


@query("s01_scan_candidates", CAND + f"SELECT CASE WHEN {K} = 3 THEN replace(candidate_id, 'CAND_', 'BAD_') WHEN {K} = 0 THEN NULL ELSE candidate_id END AS candidate_id, {K} IN (0, 6) AS corrupt FROM cand WHERE {K} <> 1")
def s01(spark, sf):
    return sc.parse_candidates(candidate_lines(spark, sf)).select("candidate_id", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("s02_required_keys", CAND + f"SELECT {K} NOT IN (0, 5) AS required_ok, count(*) AS n FROM cand WHERE {K} <> 1 GROUP BY 1")
def s02(spark, sf):
    return sc.validate_required(sc.parse_candidates(candidate_lines(spark, sf)), SCHEMA).groupBy("required_ok").agg(F.count("*").alias("n"))


@query("s03_ranges", CAND + f"SELECT candidate_id FROM cand WHERE {K} NOT IN (0, 1, 3, 4, 5, 6)")
def s03(spark, sf):
    return sc.validate_ranges(sc.parse_candidates(candidate_lines(spark, sf))).filter("ranges_ok").select("candidate_id")


@query("s04_quarantine", CAND + f"""SELECT CASE {K} WHEN 0 THEN 'bad_json' WHEN 5 THEN 'missing_key' ELSE 'bad_value' END AS reject_reason, count(*) AS n
FROM cand WHERE {K} IN (0, 3, 4, 5, 6) GROUP BY 1""")
def s04(spark, sf):
    return sc.quarantine_counts(sc.parse_candidates(candidate_lines(spark, sf)), SCHEMA)


@query("s04_ingest", CAND + f"""SELECT CASE {K} WHEN 0 THEN 'bad_json' WHEN 5 THEN 'missing_key' WHEN 3 THEN 'bad_value' WHEN 4 THEN 'bad_value' WHEN 6 THEN 'bad_value'
  ELSE 'good' END AS verdict, count(*) AS n, true AS stored FROM cand WHERE {K} <> 1 GROUP BY 1""")
def s04_ingest(spark, sf):
    path = scratch_path(spark, "ingested")
    counts = sc.ingest(candidate_lines(spark, sf), path, SCHEMA)
    held = spark.read.parquet(path).groupBy("verdict").agg(F.count("*").alias("held"))
    return counts.join(held, "verdict", "left").where("n > 0").select("verdict", "n", (F.col("n") == F.col("held")).alias("stored"))


_NAMES = "'jd_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.pdf' ELSE '.docx' END"


@query("s05_posting_files", f"SELECT {_NAMES} AS file_name, doc_id % 4 <= 1 AS accepted FROM documents")
def s05(spark, sf):
    docs = tb.load(spark, sf, "documents").select(F.expr(_NAMES).alias("file_name"))
    return sp.accept_postings(docs)


# Pairs over part names; names under key % 3 = 0 are not text.
@query("s06_synonyms", r"""SELECT lower(trim(regexp_replace(replace(p_name || '-' || p_partkey, '-', ' '), '\s+', ' ', 'g'))) AS synonym, lower(p_type) AS canonical FROM part WHERE p_partkey % 3 <> 0""")
def s06(spark, sf):
    part = tb.load(spark, sf, "part")
    documents = part.select(F.concat(
        F.lit('{"'), "p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit('": '),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_type", F.lit('"'))),
        F.lit("}")).alias("value"))
    return parse_synonyms(documents)


@query("s07_lookup", CAND + "SELECT candidate_id, years FROM cand WHERE candidate_id IN (SELECT 'CAND_' || lpad(CAST(o_custkey AS VARCHAR), greatest(7, length(CAST(o_custkey AS VARCHAR)))::INT, '0') FROM orders WHERE o_orderpriority = '1-URGENT')")
def s07(spark, sf):
    ids = tb.load(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.expr(tb.cid("o_custkey")).alias("candidate_id"))
    return sc.lookup(tb.candidates(spark, sf, ()), ids).select("candidate_id", F.col("profile.years_of_experience").alias("years"))


@query("s07_stored_lookup", CAND + "SELECT candidate_id, years FROM cand WHERE custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 997 = 3)")
def s07_stored(spark, sf):
    path = scratch_path(spark, "lookup")
    sc.write_lookup_store(tb.candidates(spark, sf, ()), path)
    ids = tb.load(spark, sf, "orders").filter("o_orderkey % 997 = 3").select(F.expr(tb.cid("o_custkey")).alias("candidate_id"))
    return sc.stored_lookup(spark, path, ids).select("candidate_id", F.col("profile.years_of_experience").alias("years"))


@query("s08_preflight", CAND + f"SELECT count(*) AS n_rows, count(*) FILTER ({K} <> 0) AS n_shaped, true AS accepted FROM cand WHERE {K} <> 1")
def s08(spark, sf):
    return sc.preflight(candidate_lines(spark, sf))


@query("s08_preflight_head", CAND + f"SELECT least(count(*), 5) AS n_rows FROM cand WHERE {K} <> 1")
def s08_head(spark, sf):
    # Which five rows come first is up to the scan; how many they are is not.
    return sc.preflight_head(candidate_lines(spark, sf)).select("n_rows")


@query("s09_dataset_status", "SELECT count(*) AS candidate_count, 'customer.parquet' AS file_name, 1::BIGINT AS n_files, 'loaded' AS status FROM customer")
def s09(spark, sf):
    return sc.dataset_status(tb.load(spark, sf, "customer")).select("candidate_count", "file_name", "n_files", "status")


def _ranked(spark, sf):
    return tb.flat(spark, sf, "result").withColumn("reasoning", F.concat(
        F.lit('Ranked "'), F.col("rank").cast("string"), F.lit('", of many')))


D_SUB = tb.with_flat("result") + """SELECT job_id, candidate_id, rank, final_score AS score, 'Ranked "' || rank || '", of many' AS reasoning FROM result"""


@query("s10_submission_rows", D_SUB)
def s10(spark, sf):
    return sr.submission_rows(_ranked(spark, sf))


def _store(name, check, write, read):
    @query(name, check)
    def run(spark, sf):
        path = scratch_path(spark, name)
        write(_ranked(spark, sf), path)
        return read(spark, path)
    return run


_store("s12_quoted_csv", D_SUB, lambda df, path: sr.write_submission(df, path, quote_all=True),
       lambda spark, path: sr.read_submission(spark, path).withColumn("job_id", F.col("job_id").cast("long")))
_store("s13_read_submission", D_SUB, sr.write_submission,
       lambda spark, path: sr.read_submission(spark, path).withColumn("job_id", F.col("job_id").cast("long")))
@query("s11_result_store", tb.with_flat("result") + "SELECT job_id, candidate_id, rank, final_score FROM result")
def s11(spark, sf):
    path = scratch_path(spark, "results")
    ranked = _ranked(spark, sf)
    # A rerun replaces what the first run stored, also where that had other rows.
    sr.write_results(ranked.withColumn("final_score", F.col("final_score") + 1), path)
    sr.write_results(ranked, path)
    return sr.read_results(spark, path).select(F.col("job_id").cast("long").alias("job_id"), "candidate_id", "rank", "final_score")


@query("s14_run_metrics", tb.with_flat("result") + """SELECT job_id, count(*) AS cohort_size, count(*) FILTER (is_honeypot) AS honeypots_detected_in_cohort,
round(coalesce(sum(final_score) FILTER (rank <= 100), 0) / 100, 4) AS top_100_average_score FROM result GROUP BY 1""")
def s14(spark, sf):
    return sr.run_metrics(tb.flat(spark, sf, "result"))


_STORED = "(SELECT md5(raw_text) FROM posting WHERE job_id % 4 = 0)"


def _reuse_or_run(spark, sf):
    """A store with complete, short and outdated runs: only complete current ones count."""
    postings = tb.postings(spark, sf)
    fingerprint = sr.dataset_fingerprint(spark, f"{sf}/customer.parquet")
    key = F.col("job_id") % 4
    store = sr.with_run_key(postings, fingerprint, "1").filter(key < 3).select(
        "jd_hash", (F.col("dataset_size") + F.when(key == 2, 1).otherwise(0)).alias("dataset_size"), "dataset_mtime", "version",
        F.when(key == 1, 50).otherwise(100).alias("n_rows"))
    return sr.reuse_or_run(postings, fingerprint, store, "1")


@query("s15_reuse_or_run", tb.with_flat("posting") + f"SELECT job_id FROM posting WHERE md5(raw_text) NOT IN {_STORED}")
def s15(spark, sf):
    return _reuse_or_run(spark, sf)[1].select("job_id")


@query("s15_reused", tb.with_flat("posting") + f"SELECT job_id FROM posting WHERE md5(raw_text) IN {_STORED}")
def s15_reused(spark, sf):
    return _reuse_or_run(spark, sf)[0].select("job_id")


@query("s16_index_tables", r"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ÖØ-öø-ÿ]{2,}')) AS term FROM documents),
kept AS (SELECT * FROM terms WHERE term NOT IN """ + d_list(STOP) + r"""),
vocab AS (SELECT term, count(*) AS n FROM kept GROUP BY 1 ORDER BY n DESC, term LIMIT 10000)
SELECT 'vocabulary' AS name, count(*) AS n FROM vocab UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT doc_id, term FROM kept SEMI JOIN vocab USING (term))
UNION ALL SELECT 'embeddings', count(*) FROM documents""")
def s16(spark, sf):
    from candisieve.functions.vectors import embed
    docs = _docs(spark, sf)
    vocab = rt.tfidf_fit(docs, "text")
    path = scratch_path(spark, "index")
    sr.write_index_tables(path, vocab, rt.tfidf_transform(docs, "doc_id", "text", vocab), embed(docs, "text", _load_text_statistics).drop("text"))
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ["vocabulary", "postings", "embeddings"]]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# ------------------------------------------------------------------ the funnel

@query("r13_funnel_bm25_stage", tb.with_flat("cand", "cand_skill", "job", "job_tech", "application").rstrip() + f""",
toks AS (SELECT a.job_id, c.candidate_id, {d_term_tokens(D_BM25_TEXT)} AS tokens FROM application a JOIN cand c USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, string_agg(name, ' ' ORDER BY pos) AS s FROM cand_skill GROUP BY 1) k USING (candidate_id)),
sizes AS (SELECT job_id, count(*) AS n_docs, sum(len(tokens)) / count(*) AS avg_len FROM toks GROUP BY 1),
q AS (SELECT DISTINCT job_id, unnest(string_split(lower(name), ' ')) AS term FROM job_tech),
words AS (SELECT job_id, candidate_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks),
tf AS (SELECT job_id, candidate_id, dl, term, count(*) AS tf FROM words SEMI JOIN q USING (job_id, term) GROUP BY ALL),
dfs AS (SELECT job_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
scores AS (SELECT job_id, candidate_id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (CAST(dl AS DOUBLE) / avg_len)))), 9) AS score
  FROM tf JOIN dfs USING (job_id, term) JOIN sizes USING (job_id) GROUP BY 1, 2)
SELECT job_id, candidate_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM (
  SELECT a.job_id, a.candidate_id, coalesce(s.score, 0) AS score FROM application a LEFT JOIN scores s USING (job_id, candidate_id)) x) y WHERE rank <= {FUNNEL_SIZES['bm25']}""")
def r13_bm25(spark, sf):
    out = bm25_stage(tb.applications(spark, sf), tb.jobs(spark, sf), tb.candidates(spark, sf, ("skills",)), FUNNEL_SIZES["bm25"])
    return out.withColumn("score", F.round("score", 6))


D_SPARSE = d_norm("concat_ws(' ', headline, summary, title, company, k.s, j.s, e.s)")


@query("r13_funnel_lexical_stage", tb.with_flat("cand", "cand_skill", "cand_job", "cand_edu", "job", "job_line").rstrip() + f""",
docs AS (SELECT c.candidate_id, {D_SPARSE} AS text FROM cand c
  LEFT JOIN (SELECT candidate_id, string_agg(name, ' ' ORDER BY pos) AS s FROM cand_skill GROUP BY 1) k USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, string_agg(title || ' ' || company || ' ' || description, ' ' ORDER BY pos) AS s FROM cand_job GROUP BY 1) j USING (candidate_id)
  LEFT JOIN (SELECT candidate_id, string_agg(degree || ' ' || field || ' ' || institution, ' ' ORDER BY pos) AS s FROM cand_edu GROUP BY 1) e USING (candidate_id)),
queries AS (SELECT j.job_id, lower(concat_ws(' ', j.title, j.summary, string_agg(l.line, ' ' ORDER BY l.idx))) AS text FROM job j JOIN job_line l USING (job_id) GROUP BY j.job_id, j.title, j.summary),
terms AS (SELECT * FROM (SELECT candidate_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ÖØ-öø-ÿ]{{2,}}')) AS term FROM docs) x WHERE term NOT IN ({", ".join(repr(w) for w in STOP)})),
vocab AS (SELECT term, count(*) AS total, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(DISTINCT candidate_id))) + 1 AS idf FROM terms GROUP BY 1 ORDER BY total DESC, term LIMIT 10000),
p AS (SELECT candidate_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY candidate_id)) AS w FROM (SELECT candidate_id, term, count(*) * any_value(idf) AS w FROM terms JOIN vocab USING (term) GROUP BY 1, 2) x),
q AS (SELECT job_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS w FROM (SELECT job_id, term, count(*) * any_value(idf) AS w FROM (
  SELECT job_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_À-ÖØ-öø-ÿ]{{2,}}')) AS term FROM queries) x JOIN vocab USING (term) GROUP BY 1, 2) y),
scores AS (SELECT job_id, candidate_id, round(sum(p.w * q.w), 9) AS score FROM p JOIN q USING (term) GROUP BY 1, 2)
SELECT job_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM (
  SELECT j.job_id, c.candidate_id, coalesce(s.score, 0) AS score FROM job j CROSS JOIN cand c LEFT JOIN scores s ON s.job_id = j.job_id AND s.candidate_id = c.candidate_id) x) y WHERE rank <= {FUNNEL_SIZES['lexical']}""")
def r13_lexical(spark, sf):
    return lexical_stage(tb.jobs(spark, sf), tb.candidates(spark, sf), FUNNEL_SIZES["lexical"])


@query("r13_funnel")
def r13(spark, sf):
    # Every stage reads the candidates again, so the derived ones are stored first.
    cand = materialize(tb.candidates(spark, sf), "candidates")
    job = materialize(tb.jobs(spark, sf), "jobs")
    vectors = materialize(cand_vectors(spark, sf), "vectors")
    out = funnel(job, cand, vectors, job_vectors(spark, sf), FUNNEL_SIZES, synonyms=synonyms(spark))
    return out.select("job_id", "candidate_id", "rank", "final_score", "is_honeypot", "reasoning")


