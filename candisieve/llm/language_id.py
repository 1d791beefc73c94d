"""Language identification with error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over hashed byte n-grams predicts
it. Decoding weighs the loss of every bit by how well that bit is known to separate the language,
and takes the nearest codeword; a runner-up close by flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.llm.common import _LOWER, text_blocks

ORDERS = (1, 2, 3)
BITS = 15
MARGIN = 0.1
UNDETERMINED = "und"
PIECE_BYTES = 1 << 20


def gram_buckets(raw: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at every byte; A-Z count as a-z."""
    code = _LOWER[raw].astype(np.uint32) + np.uint32(1 + order)
    value = code.copy()
    for back in range(1, order):
        value[back:] += code[:-back] * np.uint32((0x85EBCA6B * (2 * back + 1)) & 0xFFFFFFFF)
    value = (value ^ (value >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (value >> np.uint32(32 - BITS)).astype(np.int32)


def long_grams(raw: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Buckets of a long text's n-grams, from pieces that overlap by one, so that what is held does not grow with it."""
    for at in range(0, len(raw), PIECE_BYTES):
        yield gram_buckets(raw[at: at + PIECE_BYTES + order - 1], order)[order - 1:]


def inside(n: int, offsets: np.ndarray, order: int) -> np.ndarray:
    """Marks the bytes at which an n-gram ends that lies in one text."""
    ok = np.ones(n, bool)
    for back in range(order - 1):
        at = offsets[:-1] + back
        ok[at[at < offsets[1:]]] = False
    return ok


def codewords(languages: int) -> np.ndarray:
    """+1/-1 codewords of equal distance, one row per language; columns that tell none apart are left out."""
    size = 1 << max(1, int(languages).bit_length())
    rows, cols = np.arange(1, languages + 1)[:, None], np.arange(size)[None, :]
    code = 1 - 2 * np.array([[bin(x).count("1") & 1 for x in row] for row in (rows & cols)])
    return code[:, (code != code[:1]).any(axis=0)]


class Model:
    """Weights of all bits, the codewords, and the weight of each bit's loss for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        smooth = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * counts.shape[1])
        bits = []
        for column in self.code.T:
            bits.append(np.log(smooth[column > 0].mean(axis=0) / smooth[column < 0].mean(axis=0)))
        self.weights = np.array(bits, np.float32).T.reshape(counts.shape[1], -1).copy()
        drift = np.maximum((smooth @ self.weights) * self.code, 1e-6) if bits else np.zeros((len(languages), 0))
        self.loss_weights = drift / np.maximum(drift.sum(axis=1, keepdims=True), 1e-12)

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text and bit: summed evidence over the square root of the number of n-grams."""
        n = len(offsets) - 1
        total, seen = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full) or not self.weights.shape[1]:
            return total
        if n == 1 and len(raw) > PIECE_BYTES:
            for order in ORDERS:
                for buckets in long_grams(raw, order):
                    total += self.weights[buckets].sum(axis=0, dtype=np.float64)
                    seen += len(buckets)
            return total / np.sqrt(np.maximum(seen, 1))[:, None]
        for order in ORDERS:
            ok = inside(len(raw), offsets, order)
            found = self.weights[gram_buckets(raw, order)]
            found[~ok] = 0
            total[full] += np.add.reduceat(found, offsets[full], axis=0, dtype=np.float64)
            seen[full] += np.add.reduceat(ok, offsets[full], dtype=np.int64)
        return total / np.sqrt(np.maximum(seen, 1))[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its share among all, and whether the runner-up is close."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins)), np.zeros(len(margins), bool)
        loss = np.zeros((len(margins), len(self.languages)))
        for k, (word, weight) in enumerate(zip(self.code, self.loss_weights)):
            loss[:, k] = np.logaddexp(0, -margins * word) @ weight
        best = loss.argmin(axis=1)
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        share = 1 / near.sum(axis=1)
        order = np.sort(loss, axis=1)
        return best, share, order[:, 1] - order[:, 0] < MARGIN


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Count n-grams per language over all rows with a language; None if there are none.

    Tasks send one row per language and bucket they have seen, so what is shuffled is bounded by the
    number of tasks, and what reaches the driver by languages times buckets.
    """
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, raw, offsets in text_blocks(batch.column(1)):
                if len(raw) > PIECE_BYTES and hi - lo == 1:
                    tally = sum(np.bincount(buckets, minlength=1 << BITS) for order in ORDERS for buckets in long_grams(raw, order))
                    held[langs[lo]] = held.get(langs[lo], 0) + tally.astype(np.int64)
                    continue
                owner = np.repeat(np.arange(hi - lo), np.diff(offsets))
                names, place = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                for order in ORDERS:
                    ok = inside(len(raw), offsets, order)
                    cells = place[owner[ok]] * (1 << BITS) + gram_buckets(raw, order)[ok]
                    tally = np.bincount(cells, minlength=len(names) << BITS).reshape(len(names), -1)
                    for name, one in zip(names, tally):
                        held[name] = held[name] + one if name in held else one.astype(np.int64)
        for name, tally in held.items():
            where = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(tally[where], pa.int64())],
                ["lang", "bucket", "n"])

    parts = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((len(languages), 1 << BITS))
    np.add.at(counts, (pd.Categorical(table["lang"], languages).codes, table["bucket"].to_numpy()), table["n"].to_numpy())
    return Model(languages, counts)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every whole text.

    A null text or one without a letter is ``und`` with score 0, as is any text if no row had a
    language to learn from. Repeated rows are predicted each; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.select("doc_id", F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            texts = batch.column(1)
            names = np.full(len(texts), UNDETERMINED, object)
            scores, close = np.zeros(len(texts)), np.zeros(len(texts), bool)
            there = np.asarray(texts.is_valid())
            if known is not None:
                for lo, hi, raw, offsets in text_blocks(texts, 1 << 16):
                    best, share, near = known.decode(known.margins(raw, offsets))
                    names[lo:hi] = np.array(known.languages, object)[best]
                    scores[lo:hi], close[lo:hi] = share, near
                names[~there], scores[~there], close[~there] = UNDETERMINED, 0.0, False
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(scores), pa.array(close)],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language with a score of ``least`` at least."""
    # Rows travel whole in one column, so their names cannot clash with the flag.
    flagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                          F.when(has_letter(F.col("`text`")), F.col("`text`")).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            texts = batch.column(1)
            good = np.zeros(batch.num_rows, bool)
            if known is not None:
                for lo, hi, raw, offsets in text_blocks(texts, 1 << 16):
                    good[lo:hi] = known.decode(known.margins(raw, offsets))[1] >= least
            good &= np.asarray(texts.is_valid())
            yield batch.select(["_row"]).filter(pa.array(good))

    return flagged.mapInArrow(keep, flagged.select("_row").schema).select("_row.*")
