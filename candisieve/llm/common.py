"""Helpers the operators share: held-out folds, white space, and word hashes over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words: blank and the five controls from tab to carriage return.
BLANKS = "\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; -1 where the key is null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts, F.lit(-1))


def squeeze(text: Column) -> Column:
    """Every run of blanks as one space; null as empty. The regular expression runs only where runs remain."""
    flat = F.coalesce(text, F.lit(""))
    for char in BLANKS:
        flat = F.replace(flat, F.lit(char), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def tagged(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


# Word hashes: one polynomial over a block of bytes, from which every word's hash is a difference of
# two running sums. All arithmetic is modulo 2**64.

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.RandomState(20240917).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


_MOST_POWERS = 1 << 22  # kept for the next block; a longer one makes its own


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS
    if len(held["up"]) < n:
        held = _POWERS if n <= _MOST_POWERS else {}
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            held[name] = np.multiply.accumulate(steps)
    return held["up"][:n], held["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as ``(first, last, bytes, offsets)``.

    A block holds about ``size`` bytes, or one longer text whole. Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, raw[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, in order, and the index of each text's first word (one more at the end)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    blank = _BLANK[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw] if lower else raw] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def text_column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)
