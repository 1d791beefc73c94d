"""Exact duplicates, archive and mixing on rows with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from candisieve.llm import exact_dedup, mixing, warc

LONG = "word " * 40_000
TEXTS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "A b"), (6, "a\tb"), (7, LONG), (8, LONG + " "), (None, "a b"), (2, "a b"), (9, "a b ")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"norm": F.lit(1), "key": F.lit("x"), "bucket": F.lit(None).cast("string"), "source": F.lit("s")})


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_every_row_gets_the_smallest_id_of_equal_texts(spark):
    got = exact_dedup.exact_duplicates(docs(spark)).collect()
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[plain(t)].append(i)
    want = sorted((str(i), min(x for x in groups[plain(t)] if x is not None), len(groups[plain(t)]),
                   hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.doc_id for r in got if r.kept) == [1, 3, 5, 7, 9]


def test_buckets_split_until_they_fit(spark):
    many = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1_000).alias("text"))
    got = exact_dedup.exact_duplicates(many, capacity=20)
    sizes = exact_dedup.exact_index(many, capacity=20).groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in sizes) <= 20 and sum(r["count"] for r in sizes) == 1_000
    assert got.where("kept").count() == 1_000 and got.where("group_size <> 3 or keep_id <> doc_id % 1000").isEmpty()


def test_stage_keeps_one_whole_row(spark):
    kept = exact_dedup.drop_exact_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 9]


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_duplicates(none).isEmpty() and exact_dedup.drop_exact_duplicates(none).isEmpty()
    assert mixing.mix_sources(none).isEmpty() and mixing.mixed_documents(none).isEmpty()
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_archive_gives_back_every_record(spark, tmp_path):
    page = "<p>é " + "x" * 120
    rows = [(5, "http://a/1", page), (2, "http://a/2\r\nX: y", page), (9, None, page), (3, "u", None), (4, "u", ""), (6, "u", "short"),
            (7, "u", "short"), (2, "again", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages, path)
    back = warc.read_archive(spark, path).withColumn("whole", warc.original_record(F.col("head"), F.col("payload"))).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in back) == sorted((i, (h or "").encode()) for i, _, h in rows)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in back:
        head, block = bytes(r.whole).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4 and block.endswith(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()
    report = warc.archive_report(spark, path).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in report if r.refers_to) == [
        (2, "revisit", 2), (5, "revisit", 2), (9, "revisit", 2)]
    assert sum(r.record_type == "response" for r in report) == 5


def test_targets_meet_bounds_and_shares(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 6 else None) for i in range(600)] + [(1000, None, "s0"), (None, "a b", "s1"), (3, "a", "s2")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x"))
    got = mixing.mix_sources(table).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size
    names = sorted(x for x in by if x is not None) + [None]
    total = sum(r.size for r in got)
    left, live, target = 1.5 * total, {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}, {}
    while live:
        level = left / sum(live.values())
        full = [n for n in live if live[n] * level > 2 * by[n][0].source_size]
        if not full:
            target |= {n: w * level for n, w in live.items()}
            break
        for n in full:
            target[n] = 2.0 * by[n][0].source_size
            left -= target[n]
            del live[n]
    for n in names:
        assert abs(by[n][0].target - target[n]) < 1e-6 * total
        assert abs(sum(r.taken for r in by[n]) - target[n]) <= 1
    again = mixing.mix_sources(table.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_every_pass_serves_its_copy(spark):
    table = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("only").alias("source"))
    for passes in (2, 3, 4):
        settings = dict(weights=(1,), slopes=(0.0,), share=float(passes), passes=passes)
        served = [r.doc_id for r in mixing.mixed_documents(table, **settings).collect()]
        assert len(served) == 40 * passes and all(served[k] == served[k + 40] for k in range(40 * (passes - 1)))


def test_positions_follow_the_schedule(spark):
    table = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("only").alias("source"))
    got = mixing.mix_sources(table, weights=(1,), slopes=(0.5,), share=1.0)
    # A rising schedule has served (1 - s) t + s t^2 of its demand at time t.
    half = got.where("position < 0.5").count() / 2_000
    assert abs(half - (0.5 * 0.5 + 0.5 * 0.25)) < 0.01
    order = [r.position for r in mixing.mix_sources(table).collect() if r.position is not None]
    assert order == sorted(order)


def test_documents_meet_their_entries_by_way_of_the_directory(spark):
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    index = exact_dedup.build_index(many, capacity=20)
    slots = index.slots.orderBy("slot").collect()
    assert [r.slot for r in slots] == list(range(1 << index.depth)) and index.depth > 3
    assert all(r.owner <= r.slot < r.owner + (1 << index.depth - r.depth) and r.bucket == r.owner >> index.depth - r.depth for r in slots)
    rows = exact_dedup.keyed(many).select("doc_id", "key")
    first = index.owned(rows).where("owner = 0").count()
    lost = index._replace(slots=index.slots.where("owner <> 0"))
    assert 0 < first < 900 and lost.owned(rows).count() == 900 - first


def test_texts_of_one_hash_form_a_chain(spark, monkeypatch):
    plain_key = exact_dedup.keyed
    monkeypatch.setattr(exact_dedup, "keyed", lambda d: plain_key(d).withColumn("key", F.length("norm").cast("long")))
    rows = [(i, f"{'ab'[i % 2]}{i % 5}") for i in range(40)] + [(50, "abc"), (51, None), (52, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_duplicates(table, capacity=1).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, min(groups[t or ""]), len(groups[t or ""])) for i, t in rows}
    assert len(got) == len(rows) and sorted({r.chain for r in got}) == list(range(1, 11))
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(table, capacity=1).collect()) == sorted(map(min, groups.values()))
