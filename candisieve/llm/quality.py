"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's features are its lower-cased words and its pairs of neighbouring words, each hashed into
``2**BITS`` buckets and weighted by its share among the text's features. A pair that repeats one
word counts as one and the same feature whatever the word is, so repetition can be learned from
words never seen. Scores are sparse dot products with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.llm.common import mix, text_blocks, word_hashes

BITS = 18
MOST_ROWS = 20_000
# Copies of a text are learned one by one up to so many, beyond that in so many equal parts.
MOST_STEPS = 64
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4
SCALE = 20.0
REPEATED = np.uint64(0xD1B54A32D192ED03)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a block's words, pairs and word ends, text by text, and each text's first feature."""
    words, first = word_hashes(raw, offsets)
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    following = np.ones(n, bool)
    starts = first[:-1][first[:-1] < n]
    following[starts] = False
    pairs = words.copy()
    pairs[1:] = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0x9E3779B97F4A7C15))
    pairs[1:][words[:-1] == words[1:]] = REPEATED
    # A text's first word has no left neighbour; it stands for its own pair.
    both = np.empty(2 * n, np.uint64)
    both[0::2], both[1::2] = words, np.where(following, pairs, mix(words + np.uint64(1)))
    return (both >> np.uint64(64 - BITS)).astype(np.int64), first * 2


def train(texts: Iterator[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, copies: np.ndarray | None = None) -> np.ndarray:
    """FTRL-proximal over texts given as ``(buckets, shares)``; the weights, with the constant last.

    A text of many ``copies`` is learned as often, in a row; the steps are ``MOST_STEPS`` at most and
    then stand for several copies each.
    """
    dim = 1 << BITS
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        lead = z[at]
        w = -(lead - np.sign(lead) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(lead) <= L1, 0.0, w)

    rows = list(texts)
    times = np.ones(len(rows), np.int64) if copies is None else copies
    for _ in range(epochs):
        for (at, x), y, count in zip(rows, labels, times):
            steps = min(int(count), MOST_STEPS)
            for _ in range(steps):
                w = weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - y) * x if steps == count else (p - y) * x * (count / steps)
                step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - step * w
                n[at] += g * g
    return weights(np.arange(dim + 1)).astype(np.float32)


def sparse_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and shares of every text, with a constant feature at the end."""
    for lo, hi, raw, offsets in text_blocks(column):
        buckets, first = features(raw, offsets)
        for k in range(hi - lo):
            at, count = np.unique(buckets[first[k]: first[k + 1]], return_counts=True)
            share = SCALE * count / max(1, count.sum())
            yield np.append(at, 1 << BITS), np.append(share, 1.0)


def text_rank(text: Column) -> Column:
    """The place of a text in the order of the sample."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def training_rows(
    labelled: DataFrame, text: str = "text", label: str = "label", most_rows: int = MOST_ROWS, rank: str | None = None,
) -> DataFrame:
    """``text, label, copies, rank``: equal rows collapsed, at most about ``most_rows`` of them.

    Those with the smallest hash of their text are taken. The share is that of the collapsed rows, so a
    text of many copies takes one place, and the cut comes before the texts are grouped. ``rank`` names
    a column that holds ``text_rank`` already; computed before a join, it is counted without the texts.
    """
    place = F.col(f"`{rank}`") if rank else text_rank(F.col(f"`{text}`"))
    ranked = labelled.select(
        F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("int").alias("label"), place.alias("rank")).where("label is not null")
    share = min(1.0, most_rows / max(1, ranked.select("rank", "label").distinct().count()))
    chosen = ranked.where(F.col("rank") <= min(2**63 - 1, int(share * 2**63)))
    return chosen.groupBy("text", "label", "rank").agg(F.count(F.lit(1)).alias("copies"))


def fit(
    labelled: DataFrame, text: str = "text", label: str = "label", most_rows: int = MOST_ROWS, rank: str | None = None,
) -> np.ndarray:
    """Weights from at most about ``most_rows`` different rows with a 0/1 label; zero weights if there are none.

    The bound of ``training_rows`` is the operator's only sample; copies of a row that is taken all
    count. Order follows the hash of the text, so reruns agree.
    """
    chosen = training_rows(labelled, text, label, most_rows, rank).repartition(1).sortWithinPartitions("rank", "label", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, copies = [], [], []
        for batch in batches:
            rows.extend((at.astype(np.int32), x.astype(np.float32)) for at, x in sparse_rows(batch.column(0)))
            labels.extend(batch.column(1).to_pylist())
            copies.extend(batch.column(2).to_pylist())
        w = train(iter(rows), np.array(labels), copies=np.array(copies))
        where = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(w[where], pa.float32())], ["at", "w"])

    learned = chosen.select("text", "label", "copies").mapInArrow(learn, "at int, w float").toPandas()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[learned["at"].to_numpy()] = learned["w"].to_numpy()
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1) of every whole text.

    Null and empty texts have no words and get the score of the constant alone. Repeated rows are
    scored each; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                buckets, first = features(raw, offsets)
                sums, size = np.zeros(hi - lo), np.diff(first)
                full = np.flatnonzero(size > 0)
                if len(full):
                    sums[full] = np.add.reduceat(w[buckets], first[full], dtype=np.float64) / size[full]
                scores[lo:hi] = 1 / (1 + np.exp(-np.clip(SCALE * sums + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double")
