"""Whitening against a dense eigenvalue solver and whole-number arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candisieve.llm import whitening


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "v": F.lit("q"), "n": F.lit(None).cast("int")})


def plain(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept]
    sums = [sum(col) for col in zip(*x)]
    deviation = [sum((len(x) * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(a * len(x) - s) / len(x) for a, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return [i for i, _ in kept], deviation, centred, values[::-1], vectors[:, ::-1]


def check(spark, rows, k=32):
    ids, deviation, centred, values, vectors = plain(rows)
    got = whitening.whiten(table(spark, rows), k).collect()
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == len(ids) * k
    white = centred @ (vectors[:, :k] / np.sqrt(values[:k]))
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, own in by.items():
        assert sorted((str(r.vec_id), r.deviation) for r in own) == sorted((str(i), d) for i, d in zip(ids, deviation))
        assert all(r.n == len(ids) and abs(r.explained - values[c - 1] / values.sum()) <= 1e-9 and r.identity_error < 1e-9 for r in own)
        mine = np.array([r.whitened for r in sorted(own, key=lambda r: (str(r.vec_id), r.deviation))])
        want = white[sorted(range(len(ids)), key=lambda j: (str(ids[j]), deviation[j])), c - 1]
        sign = np.sign(mine @ want)
        assert np.abs(mine * sign - want).max() < 1e-6
    return got


def test_components_are_those_of_a_dense_solver(spark):
    rng = np.random.RandomState(0)
    rows = [(i, [float(c) for c in rng.randn(64) * 0.9 ** np.arange(64) * 3]) for i in range(900)]
    check(spark, rows)


def test_a_common_vector_and_unusable_ones(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(c) for c in rng.randn(40) * (1 + np.arange(40))]) for i in range(400)]
    same = [float(c) for c in rng.randn(40) * 200]
    rows += [(1000 + i, same) for i in range(200)]
    rows += [(5000, None), (5001, [None] + [1.0] * 39), (5002, [float("nan")] * 40), (5003, [float("inf")] + [0.0] * 39), (None, same)]
    got = check(spark, rows, 8)
    assert len({r.whitened for r in got if r.component == 1 and r.vec_id is not None and r.vec_id >= 1000}) == 1


def test_rank_ends_the_components(spark):
    rng = np.random.RandomState(2)
    rows = [(i, [float(c) for c in rng.randint(-50, 50, 6)] + [1.0] * 30) for i in range(50)]
    assert max(r.component for r in check(spark, rows)) == 6


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(40)] + [(100, [1.0]), (101, [1.0, 2.0, 3.0]), (102, [])]
    assert {r.vec_id for r in whitening.whiten(table(spark, rows)).collect()} == set(range(40))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [2.0, 2.0]), (2, [2.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    df = whitening.whiten(table(spark, rows))
    assert df.isEmpty() and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("spread", [np.zeros(100), np.r_[1e3, np.zeros(99)], np.linspace(0, 1e-3, 100), 0.7 ** np.arange(100)])
def test_flat_and_steep_spectra_are_certified(spread):
    rng = np.random.RandomState(3)
    turn, _ = np.linalg.qr(rng.randn(100, 100))
    wanted = np.sort(1 + spread if spread[0] != 1 else spread)[::-1]
    v = turn @ np.diag(wanted) @ turn.T
    found = whitening.leading(lambda q: v @ q, 100, 20, float(wanted.sum()))
    assert np.abs(found.values - wanted[:20]).max() <= 1e-10 * wanted[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(20)).max() < 1e-12


def test_deviations_beyond_64_bits_are_exact():
    known = whitening.Moments(10**7, [10**16, -3 * 10**16])
    rows = np.array([[2**33, -2**35]], np.int64)
    assert whitening.deviations(rows, known) == [sum((10**7 * int(a) - s) ** 2 for a, s in zip(rows[0], known.sums))]
