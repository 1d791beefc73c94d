"""R01-R12, R14."""

from __future__ import annotations

from pyspark.sql import functions as F

from candisieve.functions import vectors as vec
from candisieve.functions.fixed_values import FUNNEL_SIZES
from candisieve.functions.text import term_tokens
from candisieve.functions.vector_search import vector_topk
from candisieve.operators import retrieval as rt
from candisieve.session import materialize
from workloads import testbed as tb
from workloads.profile_queries import d_term_tokens
from workloads.registry import d_list, query

# The English stop words that lexical search leaves out unless told otherwise, as far as they are
# words of the index. The checking SQL has its own copy; the operators take Spark's list.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself"
    " they them their theirs themselves what which who whom this that these those am is are was were be been being have has had"
    " having do does did doing a an the and but if or because as until while of at by for with about against between into through"
    " during before after above below to from up down in out on off over under again further then once here there when where why"
    " how all any both each few more most other some such no nor not only own same so than too very s t can will just don should"
    " now cannot could ought would").split()
LEXICAL_DEPTH = FUNNEL_SIZES["lexical"]
D_TOKENS = r"regexp_extract_all(lower(text), '[A-Za-z0-9_À-ÖØ-öø-ÿ]{2,}')"
D_TERMS = f"""terms AS (SELECT doc_id, term FROM (SELECT doc_id, unnest({D_TOKENS}) AS term FROM documents) t
  WHERE term NOT IN {d_list(STOP)})"""
D_VOCAB = """vocab AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df,
  ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf
  FROM terms GROUP BY term ORDER BY total DESC, term LIMIT 10000)"""
D_POSTINGS = """postings AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
  SELECT doc_id, term, count(*) * any_value(idf) AS w FROM terms JOIN vocab USING (term) GROUP BY doc_id, term) x)"""
D_QPOSTINGS = f"""qpostings AS (SELECT job_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS weight FROM (
  SELECT job_id, term, count(*) * any_value(idf) AS w FROM (SELECT item_id AS job_id, unnest({D_TOKENS}) AS term FROM benchmark) q
  JOIN vocab USING (term) GROUP BY job_id, term) x)"""
D_TFIDF = f"WITH {D_TERMS}, {D_VOCAB}, {D_POSTINGS}, {D_QPOSTINGS}"
D_TFIDF_SCORES = """scores AS (SELECT job_id, doc_id, round(sum(p.weight * q.weight), 9) AS score
  FROM postings p JOIN qpostings q USING (term) GROUP BY job_id, doc_id)"""
D_TFIDF_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT b.item_id AS job_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d
  LEFT JOIN scores s ON s.job_id = b.item_id AND s.doc_id = d.doc_id) x)"""


def _docs(spark, sf):
    # The given table is one row group; dealt out before its texts are cut into words, it is not read as one task's work.
    return tb.load(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")


def _queries(spark, sf):
    return tb.load(spark, sf, "benchmark").select(F.col("item_id").alias("job_id"), "text")


def _tfidf(spark, sf):
    docs, queries = _docs(spark, sf), _queries(spark, sf)
    vocab = materialize(rt.tfidf_fit(docs, "text"), "vocabulary")
    postings = rt.tfidf_transform(docs, "doc_id", "text", vocab)
    return docs, queries, postings, rt.tfidf_transform(queries, "job_id", "text", vocab)


def _tfidf_top(spark, sf, k):
    docs, queries, postings, wanted = _tfidf(spark, sf)
    best, met = rt.tfidf_topk(postings, wanted, "doc_id", k, queries.count())
    return rt.topk_with_fill(best, docs, queries, "doc_id", k), met


@query("r01_tfidf_fit", f"WITH {D_TERMS}, {D_VOCAB} SELECT term, total, df, round(idf, 6) AS idf FROM vocab")
def r01(spark, sf):
    return rt.tfidf_fit(_docs(spark, sf), "text").select("term", "total", "df", F.round("idf", 6).alias("idf"))


@query("r02_tfidf_transform", f"WITH {D_TERMS}, {D_VOCAB}, {D_POSTINGS} SELECT doc_id, term, round(weight, 6) AS weight FROM postings")
def r02(spark, sf):
    docs = _docs(spark, sf)
    out = rt.tfidf_transform(docs, "doc_id", "text", rt.tfidf_fit(docs, "text"))
    return out.withColumn("weight", F.round("weight", 6))


@query("r03_tfidf_scores", f"{D_TFIDF}, {D_TFIDF_SCORES} SELECT job_id, doc_id, round(score, 6) AS score FROM scores")
def r03(spark, sf):
    docs, queries, postings, wanted = _tfidf(spark, sf)
    return rt.tfidf_scores(postings, wanted, "doc_id", docs.count(), queries.count()).withColumn("score", F.round("score", 6))


@query("r04_tfidf_top", f"""{D_TFIDF}, {D_TFIDF_SCORES}, {D_TFIDF_RANKED}
SELECT job_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {LEXICAL_DEPTH}""")
def r04(spark, sf):
    return _tfidf_top(spark, sf, LEXICAL_DEPTH)[0].withColumn("score", F.round("score", 6))


def _load_text_statistics():
    """A caller's model for R05: plain counts, nothing learned."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), t.count(" "), t.count("e"), t.count(".")] for t in texts], dtype=np.float32)
    return encode


@query("r05_embed", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS d0,
  CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS d1,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS d2,
  CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS d3 FROM documents""")
def r05(spark, sf):
    out = vec.embed(_docs(spark, sf), "text", _load_text_statistics)
    return out.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(4)])


@query("r06_l2_normalize", """SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos,
  round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS value
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e""")
def r06(spark, sf):
    e = tb.load(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(vec.l2_normalize(vec.as_vector("embedding"))).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


# One query vector per label: its first vector.
D_VECTOR_QUERIES = """vq AS (SELECT CAST(label AS BIGINT) AS job_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label)"""
D_VECTOR_RANKED = """vranked AS (SELECT job_id, vec_id, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT job_id, vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM vq CROSS JOIN embeddings) x)"""


def _vector_queries(spark, sf):
    return tb.load(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("job_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding"))


@query("r07_vector_top", f"""WITH {D_VECTOR_QUERIES}, {D_VECTOR_RANKED}
SELECT job_id, vec_id, round(score, 6) AS score, rank FROM vranked WHERE rank <= 50""")
def r07(spark, sf):
    out = vector_topk(tb.load(spark, sf, "embeddings"), _vector_queries(spark, sf), 50, "vec_id")
    return out.withColumn("score", F.round("score", 6))


# Two lists over the same ids: documents by TF-IDF, vectors by inner product, for the shared query numbers.
@query("r08_rank_fusion", f"""{D_TFIDF}, {D_TFIDF_SCORES}, {D_TFIDF_RANKED}, {D_VECTOR_QUERIES}, {D_VECTOR_RANKED},
a AS (SELECT job_id, doc_id AS id, rank FROM ranked WHERE rank <= 80), b AS (SELECT job_id, vec_id AS id, rank FROM vranked WHERE rank <= 80)
SELECT job_id, id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, id) AS rank FROM (
  SELECT job_id, id, 1.0::DOUBLE / (60 + coalesce(a.rank, 100000)) + 1.0::DOUBLE / (60 + coalesce(b.rank, 100000)) AS score
  FROM a FULL JOIN b USING (job_id, id)) x) y WHERE rank <= 40""")
def r08(spark, sf):
    a = _tfidf_top(spark, sf, 80)[0].withColumnRenamed("doc_id", "id")
    b = vector_topk(tb.load(spark, sf, "embeddings"), _vector_queries(spark, sf), 80, "vec_id").withColumnRenamed("vec_id", "id")
    return rt.rrf(a, b, "id", 40).withColumn("score", F.round("score", 9))


D_BM25 = f"""WITH toks AS (SELECT doc_id, {d_term_tokens('text')} AS tokens FROM documents),
words AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM toks),
sizes AS (SELECT count(*) AS n_docs, sum(len(tokens)) / count(*) AS avg_len FROM toks),
dfs AS (SELECT term, count(DISTINCT doc_id) AS df,
  ln(((SELECT n_docs FROM sizes) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1) AS idf FROM words GROUP BY term),
qterms AS (SELECT job_id, term, count(*) AS qtf FROM (SELECT item_id AS job_id, unnest({d_term_tokens('text')}) AS term FROM benchmark) q GROUP BY 1, 2),
scores AS (SELECT job_id, doc_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (CAST(dl AS DOUBLE) / (SELECT avg_len FROM sizes))))), 9) AS score
  FROM (SELECT doc_id, dl, term, count(*) AS tf FROM words GROUP BY 1, 2, 3) c JOIN dfs USING (term) JOIN qterms USING (term) GROUP BY 1, 2)"""


def _bm25_inputs(spark, sf):
    docs = _docs(spark, sf).select("doc_id", term_tokens(F.lower("text")).alias("tokens"))
    queries = _queries(spark, sf).select("job_id", term_tokens(F.lower("text")).alias("tokens"))
    return docs, queries


@query("r09_bm25_stats", f"""{D_BM25} SELECT term, df, round(idf, 6) AS idf, n_docs, round(avg_len, 6) AS avg_len FROM dfs, sizes""")
def r09(spark, sf):
    sizes, terms = rt.bm25_stats(_bm25_inputs(spark, sf)[0])
    return terms.select("term", "df", F.round("idf", 6).alias("idf"),
                        sizes.select("n_docs").scalar().alias("n_docs"),
                        F.round(sizes.select("avg_len").scalar(), 6).alias("avg_len"))


@query("r10_bm25_score", f"{D_BM25} SELECT job_id, doc_id, round(score, 6) AS score FROM scores")
def r10(spark, sf):
    docs, queries = _bm25_inputs(spark, sf)
    return rt.bm25_scores(docs, "doc_id", queries).withColumn("score", F.round("score", 6))


@query("r11_bm25_top", f"""{D_BM25} SELECT job_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT b.item_id AS job_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d
    LEFT JOIN scores s ON s.job_id = b.item_id AND s.doc_id = d.doc_id) x) y WHERE rank <= 100""")
def r11(spark, sf):
    docs, queries = _bm25_inputs(spark, sf)
    best = rt.bm25_topk(docs, "doc_id", queries, 100)[0]
    return rt.topk_with_fill(best, docs, queries, "doc_id", 100).withColumn("score", F.round("score", 6))


# Vectors of candidates and jobs by key arithmetic over the embeddings table.
VEC_OF = "(SELECT max(vec_id) + 1 FROM {embeddings})"
CAND_VEC = f"""SELECT candidate_id, e.embedding FROM (
    SELECT {tb.cid('c_custkey')} AS candidate_id, c_custkey % {VEC_OF} AS v FROM {{customer}}) c
  JOIN {{embeddings}} e ON e.vec_id = c.v"""
JOB_VEC = f"""SELECT job_id, e.embedding AS job_embedding FROM (
    SELECT s_suppkey AS job_id, (s_suppkey * 7 + 3) % {VEC_OF} AS v FROM {{supplier}}) s
  JOIN {{embeddings}} e ON e.vec_id = s.v"""
ROLE_VEC = f"""SELECT candidate_id, e.embedding, o_orderkey FROM (
    SELECT {tb.cid('o_custkey')} AS candidate_id, o_orderkey, o_orderkey % {VEC_OF} AS v FROM {{orders}}) o
  JOIN {{embeddings}} e ON e.vec_id = o.v"""


def vectors(spark, sf, sql):
    names = [t for t in tb.BASE_TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: tb.load(spark, sf, t) for t in names})


def d_vectors(sql):
    for t in tb.BASE_TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


D_COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query("r12_dense_top", tb.with_flat("application").rstrip() + f""", cv AS ({d_vectors(CAND_VEC)}), jv AS ({d_vectors(JOB_VEC)})
SELECT job_id, candidate_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM (
    SELECT job_id, candidate_id, round({D_COS.format('embedding', 'job_embedding')}, 9) AS score
    FROM application JOIN cv USING (candidate_id) JOIN jv USING (job_id)) x) y WHERE rank <= 30""")
def r12(spark, sf):
    cohort = tb.applications(spark, sf).join(vectors(spark, sf, CAND_VEC), "candidate_id")
    out = rt.dense_topk(cohort, vectors(spark, sf, JOB_VEC), 30)
    return out.withColumn("score", F.round("score", 6))


@query("r14_max_role_similarity", tb.with_flat("application").rstrip() + f""", rv AS ({d_vectors(ROLE_VEC)}), jv AS ({d_vectors(JOB_VEC)})
SELECT job_id, candidate_id, round(max(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(job_embedding AS DOUBLE[]))), 6) AS similarity
FROM application JOIN rv USING (candidate_id) JOIN jv USING (job_id) GROUP BY 1, 2""")
def r14(spark, sf):
    roles = vectors(spark, sf, ROLE_VEC).groupBy("candidate_id").agg(
        F.collect_list(vec.as_vector("embedding")).alias("role_embeddings"))
    pairs = tb.applications(spark, sf).join(roles, "candidate_id").join(vectors(spark, sf, JOB_VEC), "job_id")
    return pairs.select("job_id", "candidate_id", F.round(
        vec.max_similarity(F.col("role_embeddings"), vec.as_vector("job_embedding")), 6).alias("similarity"))
