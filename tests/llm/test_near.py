"""Similarity join, components, nearest neighbours and the pipeline against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candisieve import session
from candisieve.llm import ann, jaccard_join
from candisieve.llm.components import components


def shingles(text, words):
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(own[k: k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()


def brute_components(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def made(seed, groups=12, copies=9):
    rng = np.random.RandomState(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(400)]
    shared = list(rng.choice(vocabulary, 60))
    for _ in range(groups):
        base = list(rng.choice(vocabulary, rng.randint(3, 120)))
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randint(len(own))] = str(rng.choice(vocabulary))
            rows.append(" ".join(own))
    rows += [" ".join(shared + list(rng.choice(vocabulary, 30))) for _ in range(15)]
    rows += ["", None, " \t", "one", "One", "one two", "one two", "a b c d", "A b c d e"]
    return [(int(k), t) for k, t in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("seed, words, percent, small", [(1, 4, 85, False), (2, 5, 80, True), (3, 2, 60, True)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, words, percent, small):
    if small:  # many blocks, long lists and hubs on few rows
        for name, value in (("BLOCK_TEXTS", 4), ("LONG_LIST", 3), ("HUBS", 1)):
            monkeypatch.setattr(jaccard_join, name, value)
    rows = made(seed)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "cluster": F.lit("x")})
    got = jaccard_join.near_duplicates(table, words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, words, percent)
    assert len(got) == len(rows)


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "x y z"), (9, "long " + "q r s t " * 30_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.near_duplicates(table).collect())
    assert got == [("7", "7"), ("7", "7"), ("9", "9"), ("None", "7"), ("None", "None")]
    assert jaccard_join.near_duplicates(table.where("doc_id < 0")).isEmpty()


def test_stage_keeps_one_document_of_each_group(spark):
    rows = made(4)
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = jaccard_join.keep_representatives(table)
    want = {c for _, c in brute_components(rows, 5, 80).values()}
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == want


def test_paths_and_stars_have_their_smallest_node(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300), (301, 302)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300, 302: 300}


def exact_nearest(vectors, k):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 5 == 0:
            cos = [(-float(good[q] @ v / np.linalg.norm(good[q]) / np.linalg.norm(v)), i) for i, v in good.items() if i != q]
            out[q] = [(i, -c) for c, i in sorted(cos)[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.RandomState(0)
    vectors = [(i, rng.standard_normal(24).tolist()) for i in range(700)]
    vectors += [(700, None), (705, [0.0] * 24), (710, [float("nan")] + [1.0] * 23), (715, [None] + [1.0] * 23), (720, vectors[3][1]), (721, vectors[3][1])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "q": F.lit("x")})
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann, "QUERY_ROWS", 50)
    want = exact_nearest(vectors, 5)
    got: dict = {}
    for r in ann.nearest(table, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert got[720][0][0] == 3 and got[720][1][0] == 721
    assert ann.nearest(table.where("vec_id < 0"), F.col("vec_id") % 5 == 0).isEmpty()
    assert ann.nearest(table.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_chi_square():
    # Known values of the distribution with four degrees of freedom.
    assert np.allclose(ann.chi_square(np.array([0.0, 3.3567, 9.4877]), 4), [0, 0.5, 0.95], atol=1e-4)


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    source.unionByName(spark.createDataFrame([(9001, None, None, None, 0), (9002, "12 34", "en", "src1", 5), (9003, "", "fr", None, 0)], source.schema)
                       ).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    live = {i: r.text for i, r in rows.items() if r.text and re.search(r"[^\W\d_]", r.text)}
    first: dict = {}
    for i in sorted(live):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", live[i]), i)
    unique = [(i, live[i]) for i in first.values()]
    stay = {c for _, c in brute_components(unique, 5, 80).values()}
    served: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        served[r.doc_id] = served.get(r.doc_id, 0) + 1
    assert set(served) <= stay and max(served.values()) <= 2
    words = {i: len(live[i].split()) for i in stay}
    total = sum(words.values())
    assert abs(sum(n * words[i] for i, n in served.items()) - 1.5 * total) < 0.1 * total


def test_turns_and_filter_lose_no_link_and_leave_no_files(spark, monkeypatch, tmp_path):
    for name, value in (("TURN_GROUPS", 8), ("BLOCK_TEXTS", 4), ("LONG_LIST", 3), ("HUBS", 1), ("FILTER_BITS", 1 << 15), ("BITS_AN_ID", 1)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    rows = made(4)
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, 80)
    # What the result still reads: the sizes and the last round of links.
    assert sorted(p.name[:-33] for p in tmp_path.iterdir()) == ["edges", "jaccard-sizes"]
