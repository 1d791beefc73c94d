"""Stages with columns that clash with their own, reruns on repeated ids, ties and sizes of vectors, added result columns."""

import numpy as np
from pyspark.sql import functions as F

from candisieve.llm import ann, exact_dedup, language_id, mixing, pii, warc

CLASH = ("_letter", "_text", "_sha", "_own", "_again", "_mark", "_times", "_at", "_key", "_first", "_last", "_all", "keep_id", "text_sha256", "size", "rank")


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(
        {name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in CLASH})


def whole(df, rows):
    """Every row's extra columns are its own."""
    found = df.collect()
    assert df.columns == ["doc_id", "text", "lang", "source", *CLASH]
    assert all(r[name] == f"{name}{r.doc_id}" for r in found for name in CLASH)
    return sorted(r.doc_id for r in found)


def test_stages_keep_columns_of_any_name(spark):
    rows = [(k, f"the house of number {k % 8} " + "is here and there " * 4, "en", f"s{k % 2}") for k in range(24)] + [
        (100 + k, f"das haus der nummer {k} " + "ist hier und dort " * 4, "de", "s0") for k in range(24)] + [(200, None, "en", "s1"), (201, "123", "de", None)]
    docs = clashing(spark, rows)
    model = language_id.fit(docs)
    assert set(whole(language_id.keep_identified(docs, model), rows)) <= set(range(124))
    assert whole(exact_dedup.drop_exact_duplicates(docs), rows) == sorted([*range(8), *range(100, 124), 200, 201])
    assert whole(mixing.mixed_documents(docs), rows)


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(1, "same text", k) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    kept = {exact_dedup.drop_exact_duplicates(docs.repartition(n, F.rand(n))).collect()[0].extra for n in (1, 3, 5)}
    assert len(kept) == 1


def test_mix_of_repeated_and_null_ids_is_the_same_again(spark):
    rng = np.random.RandomState(0)
    ids = [None] * 40 + [7] * 40 + list(range(300))
    rows = [(i, "w " * int(rng.randint(0, 50)), f"s{rng.randint(3)}") for i in ids]
    one, two = (spark.createDataFrame([rows[k] for k in order], "doc_id long, text string, source string").repartition(n)
                for n, order in ((3, rng.permutation(380)), (7, rng.permutation(380))))
    dealt = [sorted(map(str, mixing.mix_sources(df).collect())) for df in (one, two)]
    assert dealt[0] == dealt[1]


def test_long_texts_have_the_margins_of_whole_ones(spark, monkeypatch):
    text = "the quick brown fox über die straße " * 300
    docs = spark.createDataFrame([(1, text, "en"), (2, "der schnelle fuchs " * 50, "de")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    raw = np.frombuffer(text.encode(), np.uint8)
    own = model.margins(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(language_id, "PIECE_BYTES", 100)
    assert np.allclose(model.margins(raw, np.array([0, len(raw)])), own, rtol=1e-5)
    for order in language_id.ORDERS:
        assert np.array_equal(np.concatenate(list(language_id.long_grams(raw, order))), language_id.gram_buckets(raw, order)[order - 1:])


def test_equal_vectors_tie_by_id_and_sizes_do_not_matter(spark):
    rng = np.random.RandomState(4)
    for trial in range(3):
        base = rng.randn(300, 64)
        base[100:140] = base[100]
        factor = np.where(np.arange(300) % 3 == 0, 1e200, np.where(np.arange(300) % 3 == 1, 1e-200, 1.0))
        vectors = base * np.where(np.arange(300) >= 140, factor, 1.0)[:, None]
        ids = rng.permutation(300)
        rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, vectors)]
        got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
        assert all(np.isfinite(r.score) for r in got)
        same = sorted(int(i) for i in ids[100:140])
        for query in (i for i in same if i % 10 == 0):
            own = [r.vec_id for r in sorted((r for r in got if r.query_id == query), key=lambda r: r["rank"])]
            assert own == [i for i in same if i != query][:5]


def test_scores_stand_beside_their_spans(spark):
    docs = spark.createDataFrame([(1, "mail me at a@b.org or call +49 30 1234567"), (2, None)], "doc_id long, text string")
    rows = pii.find_personal_data(docs).select("doc_id", pii.joined(*pii.KINDS).alias("spans"), pii.scores(*pii.KINDS).alias("scores")).collect()
    found = {r.doc_id: (r.spans, r.scores) for r in rows}
    assert found[2] == ("", "") and found[1][0].startswith("email:11:18,phone:27:") and found[1][1] == "1.00,0.80"


def test_record_bytes_are_those_of_the_rebuilt_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", "x" * 200), (2, None, "x" * 200), (3, "u", None)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path).select("page_id", F.length(warc.original_record(F.col("head"), F.col("payload"))).alias("n"))
    assert {r.page_id: r.n for r in back.collect()} == {r.page_id: r.record_bytes for r in warc.archive_report(spark, path).collect()}
