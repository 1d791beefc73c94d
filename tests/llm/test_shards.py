"""Shards against a plain version that sorts all records."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from candisieve.llm import sharding

SCHEMA = "doc_id long, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("size", "range", "law", "first", "nth")})


def plain(rows, shards):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    keyed = sorted((md5(t or ""), md5("" if i is None else str(i)), str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                   for i, t in rows)
    total, groups, at = sum(k[3] for k in keyed), {}, 0
    for k in keyed:
        first, size = groups.get(k[0], (at, 0))
        groups[k[0]] = (first, size + k[3])
        at += k[3]
    found, at, slots = [], 0, [0] * shards
    for text, _, i, size, crc in keyed:
        first, whole = groups[text]
        middle = 2 * first + whole if whole * shards * 64 <= total else 2 * at + size
        shard = middle * shards // (2 * total)
        found.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(found)


def got(df):
    rows = df.collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in rows)
    return sorted((str(r.doc_id), r.size, r.text_crc32, r["shard"], r.slot) for r in rows)


def made(seed, n):
    rng = np.random.RandomState(seed)
    texts = ["w" * rng.randint(0, 300) + str(k) for k in range(n)]
    # A third of the rows are copies of one text, a third of the rest has none.
    return [(int(i), "copy é " * 9 if k % 3 == 0 else None if k % 3 == 1 and k % 2 else texts[k]) for k, i in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("seed, n, shards, ranges", [(1, 900, 8, 500_000), (2, 1500, 8, 20), (3, 40, 3, 5)])
def test_shards_are_those_of_all_records_sorted(spark, monkeypatch, seed, n, shards, ranges):
    monkeypatch.setattr(sharding, "RANGE_ROWS", ranges)
    rows = made(seed, n)
    found = got(sharding.shard_documents(table(spark, rows).repartition(7), shards))
    assert found == plain(rows, shards)
    sizes = [sum(r[1] for r in found if r[3] == s) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in found) + 2 * sum(sizes) / shards / 64


def test_nulls_repeats_and_a_text_larger_than_a_shard(spark):
    rows = [(None, None), (None, None), (1, ""), (2, "x" * 5_000), (3, "b"), (3, "b"), (3, "c"), (4, "é")]
    assert got(sharding.shard_documents(table(spark, rows))) == plain(rows, 8)


def test_rows_that_are_all_the_same_are_still_parted(spark):
    rows = [(7, "same")] * 4_000
    keys = sharding.sized_keys(table(spark, rows))
    _, held = sharding.split_ranges(keys)
    assert max(r["rows"] for r in held) < 1_000
    found = got(sharding.shard_documents(table(spark, rows)))
    assert [sum(r[3] == s for r in found) for s in range(8)] == [500] * 8


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    # Draws by bytes alone would leave the many empty texts in one range.
    monkeypatch.setattr(sharding, "DRAWS", 4)
    rows = [(i, None) for i in range(3_000)] + [(10_000 + i, "y" * 2_000 + str(i)) for i in range(300)]
    keys = sharding.sized_keys(table(spark, rows))
    _, held = sharding.split_ranges(keys)
    assert max(r["rows"] for r in held) <= 2 * 3_300 / 32 and sum(r["rows"] for r in held) == 3_300


def test_empty_table(spark):
    assert sharding.shard_documents(table(spark, [])).isEmpty()


def test_written_shards_hold_every_record(spark, tmp_path):
    rows = made(4, 500)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.col("doc_id") * 2)
    sharding.write_shards(frame, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    want = {i: s for i, _, _, s, _ in plain(rows, 8)}
    read = back.collect()
    assert set(back.columns) == {"doc_id", "text", "extra", "shard"} and len(read) == 500
    assert all(want[str(r.doc_id)] == r["shard"] and r.extra == 2 * r.doc_id for r in read)
    with pytest.raises(ValueError):
        sharding.write_shards(back, f"file://{tmp_path}/again")
