"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candisieve.llm import collocations


def plain(rows, least=30, top=2_000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
            totals[lang if lang is not None else "und"] += len(words)
            for m in range(1, 5):
                own.update(tuple(words[k: k + m]) for k in range(len(words) - m + 1))
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = [q for q in candidates if len(q) > len(p) and any(q[k: k + len(p)] == p for k in range(len(q) - len(p) + 1))]
            if not any(100 * candidates[q] >= 80 * a for q in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "phrase", "rank", "words")})


def made(seed, texts):
    rng = np.random.RandomState(seed)
    words = [f"W{k}" if k % 3 else f"é{k}" for k in range(25)]
    fixed = ["new york city hall", "To Be", "a, b", "one two three"]
    rows = []
    for k in range(texts):
        own = [fixed[rng.randint(len(fixed))] if rng.rand() < 0.2 else words[min(24, rng.geometric(0.15))] for _ in range(rng.randint(0, 60))]
        rows.append(([None, "en", "en", "und", "de"][k % 5], rng.choice([" ", "\t", "  "]).join(own) + rng.choice(["", ".", "\r\n", "!? "])))
    return rows + [("en", None), ("en", ""), (None, " \t"), ("xx", "...;"), ("", "a b " * 40)]


@pytest.mark.parametrize("seed, small", [(1, False), (2, True)])
def test_phrases_are_those_of_a_plain_count(spark, monkeypatch, seed, small):
    rows = made(seed, 250)
    docs = table(spark, rows)
    if small:  # the tasks' own limits do not reach the workers of a session, so runs are made here
        for name, value in (("BLOCK_BYTES", 40), ("MOST_ENTRIES", 50), ("MOST_VOCABULARY", 20), ("BURST", 3), ("RUN_ROWS", 7)):
            monkeypatch.setattr(collocations, name, value)
        import pyarrow as pa
        for lengths in ((1,), (2,), (3, 4)):
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" if r[0] is None else r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
            runs, seen = [], Counter()
            for run in collocations.phrase_runs(iter([batch]), lengths, None):
                rows_of = list(zip(*[c.to_pylist() for c in run.columns]))
                assert len(rows_of) <= 7 and rows_of == sorted(rows_of)
                runs.append(rows_of)
                for lang, words, prefix, rest, n in rows_of:
                    assert words in lengths
                    seen[lang, f"{prefix} {rest}".strip()] += n
            want = Counter()
            for lang, text in rows:
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                    own = re.findall(r"[^\x20\x09]+", piece)
                    want.update(("und" if lang is None else lang, " ".join(own[k: k + words])) for words in lengths for k in range(len(own) - words + 1))
            assert seen == want and len(runs) > 20
    else:
        assert got(collocations.mine_phrases(docs)) == plain(rows)


def test_a_long_text_is_read_in_overlapping_blocks(spark):
    rng = np.random.RandomState(5)
    words = [f"word{k}" for k in range(300)]
    long = " ".join(words[k] for k in rng.randint(0, 300, 400_000))
    rows = [("en", long), ("en", "x" * 3_000_000 + " y. z"), ("en", "up down " * 40)]
    own = got(collocations.mine_phrases(table(spark, rows), least=30))
    assert own == plain(rows)


def test_ties_go_to_the_first_cut_and_the_first_phrase(spark):
    rows = [("en", "b a. d c. c d e. ")] * 30
    found = got(collocations.mine_phrases(table(spark, rows)))
    assert found == plain(rows) and [r[2] for r in found if r[7] == found[0][7]] == sorted(r[2] for r in found if r[7] == found[0][7])


def test_the_filter_loses_no_phrase_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", collocations.PAGE_BITS)
    rows = made(7, 120)
    assert got(collocations.mine_phrases(table(spark, rows), least=3)) == plain(rows, least=3)


def test_no_candidates(spark):
    assert collocations.mine_phrases(table(spark, [])).isEmpty()
    assert collocations.mine_phrases(table(spark, [("en", "a b c")])).isEmpty()
