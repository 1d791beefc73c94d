"""The queries of the operators, one for each, and the pipeline; with checking SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candisieve.llm import (
    ann, collocations, exact_dedup, html_extract, jaccard_join, language_id, mixing, pii, piece_bpe, quality, sharding, warc, whitening)
from candisieve.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_bytes")


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
     r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p),
     t AS (SELECT *, n >= 100 AND page_id <> f AS again FROM r)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN f END AS refers_to,
       -- Each header line ends with two bytes more, an empty line ends the header, two the record.
       CAST(strlen('WARC/1.1') + strlen('WARC-Type: revisit') + CASE WHEN again THEN 0 ELSE 1 END
         + strlen('WARC-Record-ID: <urn:uuid:>') + 36 + strlen('WARC-Date: 2024-01-01T00:00:00Z')
         + coalesce(strlen('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]+', ' ', 'g')) + 2, 0)
         + strlen('WARC-Payload-Digest: sha256:') + 64 + coalesce(strlen('WARC-Page-ID: ' || CAST(page_id AS VARCHAR)) + 2, 0)
         + CASE WHEN again THEN strlen('WARC-Refers-To: <urn:uuid:>') + 36 + strlen('WARC-Refers-To-Page-ID: ' || CAST(f AS VARCHAR))
             + strlen('WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest') + 6 ELSE 0 END
         + strlen('Content-Type: text/html; charset=utf-8') + strlen('Content-Length: ' || CASE WHEN again THEN '0' ELSE CAST(n AS VARCHAR) END)
         + 7 * 2 + 2 + 4 + CASE WHEN again THEN 0 ELSE n END AS BIGINT) AS record_bytes
FROM t
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5(md5(coalesce(CAST(doc_id AS VARCHAR), '')) || md5(coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
v AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
             CASE k % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS slope FROM w),
l AS (SELECT *, source_size * 2 AS bound, (source_size * 2)::DOUBLE / weight AS ratio FROM v),
m AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - CAST(coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      AS level FROM l),
f AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS final FROM m),
t AS (SELECT source, source_size, slope,
             CASE WHEN final IS NULL OR weight * final > bound THEN CAST(bound AS DOUBLE) ELSE weight * final END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(round(target) AS BIGINT) AS wanted FROM r),
u AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS full_passes FROM q),
x AS (SELECT *, CAST(full_passes * size + least(size, greatest(0, wanted - full_passes * source_size - ahead)) AS BIGINT) AS taken,
             least(1::DOUBLE, ahead::DOUBLE / target) AS part FROM u)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN slope = 0 THEN part
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * part) - (1 - slope)) / (2 * slope) END + 0.0::DOUBLE, 9) END AS position
FROM x
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.joined(*pii.BASE), 256).alias("base_sha256"), pii.joined(*pii.KINDS).alias("spans"),
        pii.scores(*pii.KINDS).alias("scores"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM m LEFT JOIN n USING (doc_id)
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    # The order of the sample is taken before the join, so that its count does not move the texts.
    ranked = docs.where(~held_out).withColumn("rank", quality.text_rank(F.col("text")))
    weights = quality.fit(ranked.join(labels.where("label is not null"), "doc_id"), rank="rank")
    return quality.score_quality(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.encode_documents(table(spark, sf_dir, "documents"), piece_model())
    return digests(found)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


# A record's place follows from hashes, so the shards can be found by sorting all records. The checksum
# goes through the bytes by a table of 256 remainders, which x builds by its rule.
OP11_SQL = r"""
WITH RECURSIVE b(v, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL
  SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM b WHERE k < 8),
x AS (SELECT list(c ORDER BY v) AS tab FROM b WHERE k = 8),
h AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
y AS (SELECT body, list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(body)),
             lambda j: CAST('0x' || substr(hex(body), 2 * j + 1, 2) AS BIGINT))) AS bytes FROM h),
z AS (SELECT body, xor(list_reduce(bytes, lambda c, v: xor(c // 256, tab[xor(c, v) % 256 + 1])), 4294967295) AS crc FROM y, x),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS body,
                  substr(md5(coalesce(text, '')), 1, 16) AS t, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS i FROM documents),
o AS (SELECT *, coalesce(sum(size) OVER (ORDER BY t, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
             sum(size) OVER (PARTITION BY t) AS group_size, sum(size) OVER () AS total FROM d),
g AS (SELECT *, min(ahead) OVER (PARTITION BY t) AS group_ahead FROM o),
s AS (SELECT *, CAST(CASE WHEN group_size * 8 * 64 <= total THEN (2 * group_ahead + group_size) * 8 // (2 * total)
                     ELSE (2 * ahead + size) * 8 // (2 * total) END AS INTEGER) AS shard FROM g)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY t, i) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s JOIN z USING (body)
"""


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
g AS (SELECT lang, m, array_to_string(ws[k:k + m - 1], ' ') AS phrase
      FROM (SELECT lang, m, ws, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * k.a) // (x.f + y.f) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
             JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a AS longer, array_to_string(ws[p:p + z - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, m - z + 2)) AS p FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2))),
h AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL),
t AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_warc, op3_html_extraction, op4_source_mixing, op5_personal_data, op6_nearest_neighbours,
    op7_jaccard_join, op8_quality, op9_sentencepiece, op10_exact_dedup, op11_sharding,
    op12_collocations, op13_whitening, pipeline)}
CHECKS = {"op2_warc": OP2_SQL, "op4_source_mixing": OP4_SQL, "op7_jaccard_join": OP7_SQL, "op10_exact_dedup": OP10_SQL,
          "op11_sharding": OP11_SQL, "op12_collocations": OP12_SQL}
