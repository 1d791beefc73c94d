"""Phrases whose words belong together, counted in tries of word ids.

A task numbers its words and counts phrases in a HAT-trie: a shallow trie over the ids of the first
words whose leaves are hash containers of the remaining ids; a container that grows too large bursts
into one container per next word. When the trie is full, whole subtrees leave it as sorted runs. Runs
meet in partitions by prefix, the phrase's first two words, and are summed there.

Words are counted first, then pairs, then longer phrases: a phrase reaches the least count only if all
phrases within it do. Counted words, and later pairs, set bits of a filter of fixed size, and a task
counts only phrases all of whose words, or pairs, have their bits set. The filter lets some others
pass, never loses one, and the sums decide; so counts are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candisieve.functions.topk import top_k_per_key
from candisieve.llm.common import mix
from candisieve.session import materialize

MOST_WORDS, LEAST_COUNT, TOP = 4, 30, 2_000
INSIDE_PERCENT, SCORE_SCALE = 80, 2_000_000
NO_LANG = "und"
# What parts pieces and what parts words; A-Z in lower case.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
# Bytes counted at once, entries and words a task's trie holds, and entries at which a container bursts.
BLOCK_BYTES, MOST_ENTRIES, MOST_VOCABULARY, BURST = 1 << 20, 500_000, 400_000, 4_096
# The filter has at most this many bits, and a share of them for each phrase that is counted in it.
FILTER_BITS, BITS_A_PHRASE, PAGE_BITS = 1 << 27, 16, 32_768
RUN_ROWS = 50_000

_FOLD = bytes(bytearray(b"\n"[0] if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else 32 if c in BLANKS else c for c in range(256)))
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers from 0 up, and its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words_of(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a folded block: its 64-bit hash, start, end, and the number of pieces before it.

    A hash is a polynomial in the word's bytes, taken as the difference of two running sums. In a
    block with a word longer than a block the words are hashed one by one, a stretch at a time.
    """
    raw = np.frombuffer(block, np.uint8)
    blank = (raw == 32) | (raw == 10)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    pieces = np.searchsorted(np.flatnonzero(raw == 10), starts)
    up, down = _powers(2 * BLOCK_BYTES)
    values = raw.astype(np.uint64) + np.uint64(1)
    if len(raw) <= len(up):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(values * up[: len(raw)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * down[starts]
    else:
        found = np.zeros(len(starts), np.uint64)
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
            total = 0
            for at in range(lo, hi, len(up)):
                part = values[at: min(hi, at + len(up))]
                total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - lo, 1 << 64)
            found[k] = total % (1 << 64)
    return mix(mix(found) + (ends - starts).astype(np.uint64)), starts, ends, pieces


class Vocabulary:
    """Ids of words in order of appearance."""

    def __init__(self):
        self.ids: dict[int, int] = {}
        self.words: list[bytes] = []

    def number(self, block: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        codes, different = pd.factorize(hashes)
        first = np.empty(len(different), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        own = list(map(self.ids.get, different.tolist()))
        for k, at in enumerate(own):
            if at is None:
                own[k] = self.ids[int(different[k])] = len(self.words)
                self.words.append(block[starts[first[k]]: ends[first[k]]])
        return np.array(own, np.int64)[codes]


def step(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are longer by the following word."""
    return mix(hashes * np.uint64(_BASE) + following)


def chain(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all phrases of so many words in a row, from those of the words."""
    found = hashes
    for _ in range(words - 1):
        found = step(found[:-1], hashes[len(hashes) - len(found) + 1:])
    return found


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def place(hashes: np.ndarray, lang: np.ndarray | np.uint64, size: int) -> np.ndarray:
    """The bit of a phrase in a filter of ``size`` bits."""
    return (mix(hashes ^ lang) % np.uint64(size)).astype(np.int64)


class Filter:
    """A bit for every phrase that reached the least count."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def holds(self, hashes: np.ndarray, lang: np.uint64) -> np.ndarray:
        at = place(hashes, lang, len(self.bits) * 8)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class PhraseTrie:
    """Counts of phrases of one length, as ids below 2**32.

    The root maps a first word to a hash container, keyed by the ids of the remaining words in one
    number; a container over ``BURST`` entries bursts into a node that maps the second word to
    containers of the rest. Phrases of two words need no deeper node.
    """

    def __init__(self, words: int):
        self.words = words
        self.below = 32 * (words - 2)
        self.root: dict[int, dict[int, int]] = {}
        self.burst: dict[int, dict[int, dict[int, int]]] = {}
        self.entries = 0

    def add(self, first: list[int], rest: list[int], counts: list[int]) -> None:
        root, burst, below = self.root, self.burst, self.below
        for one, key, count in zip(first, rest, counts):
            if one in burst:
                node = burst[one]
                held = node.get(key >> below)
                if held is None:
                    held = node[key >> below] = {}
                key &= (1 << below) - 1
            else:
                held = root.get(one)
                if held is None:
                    held = root[one] = {}
            if key in held:
                held[key] += count
            else:
                held[key] = count
                self.entries += 1
                if below and len(held) > BURST and one not in burst:
                    self._split(one)

    def _split(self, one: int) -> None:
        node: dict[int, dict[int, int]] = defaultdict(dict)
        for key, count in self.root.pop(one).items():
            node[key >> self.below][key & ((1 << self.below) - 1)] = count
        self.burst[one] = dict(node)

    def largest(self, share: float) -> list[int]:
        """The first words of the largest subtrees, up to this share of all entries."""
        sizes = {one: len(held) for one, held in self.root.items()} | {
            one: sum(map(len, node.values())) for one, node in self.burst.items()}
        leaving, rest = [], self.entries * share
        for one in sorted(sizes, key=sizes.get, reverse=True):
            if rest <= 0:
                break
            leaving.append(one)
            rest -= sizes[one]
        return leaving

    def take(self, leaving: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Empty the subtrees of some first words: their phrases as rows of ids, and the counts."""
        firsts, seconds, keys, counts, sizes = [], [], [], [], []
        for one in leaving:
            for second, held in ([(None, self.root.pop(one))] if one in self.root else self.burst.pop(one).items()):
                firsts.append(one)
                sizes.append(len(held))
                counts.extend(held.values())
                if second is not None:
                    seconds.extend([second] * len(held))
                    keys.extend(held)
                elif self.below:
                    low = (1 << self.below) - 1
                    seconds.extend([key >> self.below for key in held])
                    keys.extend([key & low for key in held])
                else:
                    seconds.extend(held)
        self.entries -= len(counts)
        columns = [np.repeat(np.array(firsts, np.int64), sizes), np.array(seconds, np.int64)]
        for k in range(self.words - 3, -1, -1):
            columns.append(np.array([key >> 32 * k & 0xFFFFFFFF for key in keys], np.int64))
        return np.array(columns), np.array(counts, np.int64)


def text_stream(texts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Folded bytes in blocks that end between words, and whether a block goes on with the text before it."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if len(text) > BLOCK_BYTES:
            if held:
                yield b"\n".join(held), False
                held, size = [], 0
            at = 0
            while at < len(text):
                end = at + BLOCK_BYTES
                if end < len(text):
                    cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                    after = [p for p in (text.find(b" ", end), text.find(b"\n", end)) if p >= 0]
                    end = cut if cut > at else min(after, default=len(text))
                yield text[at:end], at > 0
                at = end
            continue
        held.append(text)
        size += len(text) + 1
        if size > BLOCK_BYTES:
            yield b"\n".join(held), False
            held, size = [], 0
    if held:
        yield b"\n".join(held), False


def counted_phrases(ids: np.ndarray, starts: np.ndarray, words: int):
    """``first, rest, counts`` of the different phrases that start at given places in a row of ids."""
    packed = ids[starts].astype(np.uint64)
    for k in range(1, words):
        if k > 1:  # the rank of the words before is packed with the next word
            _, packed = np.unique(packed, return_inverse=True)
            packed = packed.astype(np.uint64)
        packed = packed << np.uint64(32) | ids[starts + k].astype(np.uint64)
    _, at, counts = np.unique(packed, return_index=True, return_counts=True)
    at = starts[at]
    rest = ids[at + 1].tolist()
    for k in range(2, words):
        rest = [r << 32 | i for r, i in zip(rest, ids[at + k].tolist())]
    return ids[at].tolist(), rest, counts.tolist()


RUN = "lang string, words int, prefix string, rest string, n long"


class WordCounts:
    """What a trie of single words comes to: its root is one hash container, the vocabulary, with a count for each id."""

    def __init__(self):
        self.counts = np.zeros(0, np.int64)

    @property
    def entries(self) -> int:
        return len(self.counts)

    def add(self, ids: np.ndarray) -> None:
        seen = np.bincount(ids, minlength=len(self.counts))
        seen[: len(self.counts)] += self.counts
        self.counts = seen

    def take(self, leaving: None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.flatnonzero(self.counts)
        counts, self.counts = self.counts[ids], np.zeros(0, np.int64)
        return ids[None, :], counts


class Counts:
    """The tries of one language, one for each length, over one vocabulary."""

    def __init__(self, lengths: tuple[int, ...]):
        self.tries = {words: PhraseTrie(words) if words > 1 else WordCounts() for words in lengths}
        self.vocabulary = Vocabulary()

    def entries(self) -> int:
        return sum(trie.entries for trie in self.tries.values())

    def spill(self, lang: str, share: float) -> Iterator[pa.RecordBatch]:
        """The largest subtrees leave, until this share of the entries is gone: a sorted run for each length."""
        name = pa.array(self.vocabulary.words, pa.binary())
        place = np.empty(len(name), np.int64)
        place[pc.array_sort_indices(name).to_numpy()] = np.arange(len(name))
        for words, trie in self.tries.items():
            if not trie.entries:
                continue
            ids, counts = trie.take(trie.largest(share) if words > 1 else None)
            order = np.lexsort(place[ids][::-1])
            for lo in range(0, len(order), RUN_ROWS):
                part = order[lo: lo + RUN_ROWS]
                named = [name.take(pa.array(column[part])) for column in ids]
                joined = [pc.binary_join_element_wise(*some, b" ").cast(pa.string()) if some else pa.array([""] * len(part))
                          for some in (named[:2], named[2:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), pa.array(np.full(len(part), words, np.int32)), *joined,
                     pa.array(counts[part])], ["lang", "words", "prefix", "rest", "n"])


def phrase_runs(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], known: Filter | None, span: int = 1) -> Iterator[pa.RecordBatch]:
    """Sorted runs ``lang, words, prefix, rest, n`` of the phrases of ``lang, text`` batches.

    The prefix holds the first two words. ``known`` filters the phrases of ``span`` words that a
    counted one may hold. When the tries or vocabularies of a task are full, the largest subtrees of
    the largest language leave as runs, or all of them with their vocabulary.
    """
    held: dict[str, Counts] = {}
    longest = max(lengths)

    def relieve() -> Iterator[pa.RecordBatch]:
        while sum(c.entries() for c in held.values()) > MOST_ENTRIES:
            lang = max(held, key=lambda x: held[x].entries())
            yield from held[lang].spill(lang, 0.5)
        while sum(len(c.vocabulary.words) for c in held.values()) > MOST_VOCABULARY:
            lang = max(held, key=lambda x: len(held[x].vocabulary.words))
            yield from held.pop(lang).spill(lang, 1.0)

    for batch in batches:
        rows: dict[str, list[int]] = defaultdict(list)
        for k, lang in enumerate(batch.column(0).to_pylist()):
            rows[lang].append(k)
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        for lang, own in rows.items():
            seed, tail = lang_hash(lang), b""
            for block, goes_on in text_stream(texts[k].as_py().translate(_FOLD) for k in own):
                counts = held.get(lang) or held.setdefault(lang, Counts(lengths))
                # A block that goes on starts with the last words before it, so that phrases across the cut are met;
                # those that lie before it whole were counted there.
                before = words_of(tail)[1].size if goes_on and tail else 0
                block = tail + block if before else block
                hashes, starts, ends, pieces = words_of(block)
                tail = block[starts[max(0, len(starts) - longest + 1)]:] if len(starts) and longest > 1 else b""
                ids = counts.vocabulary.number(block, hashes, starts, ends)
                if len(ids) < span:
                    continue
                may = known.holds(chain(hashes, span), seed) if known is not None else np.ones(len(ids) - span + 1, bool)
                for words, trie in counts.tries.items():
                    if len(ids) < words:
                        continue
                    n = len(ids) - words + 1
                    whole = may[:n] & (pieces[:n] == pieces[words - 1:])
                    for k in range(1, words - span + 1):
                        whole &= may[k: n + k]
                    at = np.flatnonzero(whole)
                    at = at[at + words > before]
                    if words == 1:
                        trie.add(ids[at])
                    elif len(at):
                        trie.add(*counted_phrases(ids, at, words))
                yield from relieve()
    for lang, counts in held.items():
        yield from counts.spill(lang, 1.0)


def count_phrases(docs: DataFrame, lengths: tuple[int, ...], known: Filter | None = None, span: int = 1) -> DataFrame:
    """``lang, words, prefix, rest, n``: occurrences of the phrases of ``lang, text`` that the filter lets pass.

    Whole subtrees of all tasks meet in the partition of their language and prefix.
    """
    runs = docs.mapInArrow(lambda batches: phrase_runs(batches, lengths, known, span), RUN)
    return runs.repartition("lang", "prefix").groupBy("lang", "words", "prefix", "rest").agg(F.sum("n").alias("n"))


def build_filter(counted: DataFrame, words: int) -> Filter:
    """The filter over ``lang, prefix, rest``; bits are set page by page, so the driver gets the filter alone."""
    wanted = max(PAGE_BITS, BITS_A_PHRASE * counted.count())
    size = min(FILTER_BITS, 1 << (wanted - 1).bit_length())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = b"\n".join((f"{p} {r}" if r else p).encode() for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            each = words_of(names)[0].reshape(-1, words)
            hashes = each[:, 0]
            for k in range(1, words):
                hashes = step(hashes, each[:, k])
            langs = np.array([lang_hash(lang) for lang in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(place(hashes, langs, size))], ["at"])

    at = counted.select("lang", "prefix", "rest").mapInArrow(places, "at long")
    pages = at.groupBy(F.floor(F.col("at") / PAGE_BITS).alias("page")).agg(
        F.call_function("bitmap_construct_agg", F.col("at") % PAGE_BITS).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for row in pages:
        page = np.frombuffer(bytes(row["bits"]), np.uint8)[: PAGE_BITS // 8]
        bits[row["page"] * (PAGE_BITS // 8): row["page"] * (PAGE_BITS // 8) + len(page)] = page
    return Filter(bits)


def phrase(prefix: Column, rest: Column) -> Column:
    return F.when(rest == "", prefix).otherwise(F.concat_ws(" ", prefix, rest))


def counted_levels(docs: DataFrame, most_words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of every phrase with at least ``least`` occurrences, and ``lang, n``."""
    passes = [(1,), (2,), tuple(range(3, most_words + 1))]
    known, levels, totals = None, None, None
    for k, lengths in enumerate(own for own in passes if own and own[0] <= most_words):
        counted = count_phrases(docs, lengths, known, max(1, k))
        if k == 0:
            counted = materialize(counted, "phrases-1")
            totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
        else:
            counted = materialize(counted.where(F.col("n") >= least), f"phrases-{lengths[0]}")
        counted = counted.where(F.col("n") >= least)
        own = counted.select("lang", phrase(F.col("prefix"), F.col("rest")).alias("phrase"), "words", F.col("n").alias("f"))
        levels = own if levels is None else levels.unionByName(own)
        if lengths[0] < min(most_words, 3):
            known = build_filter(counted, lengths[0])
    return levels, totals


def mine_phrases(
    docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP,
    text: str = "text", lang: str = "lang",
) -> DataFrame:
    """The first ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the lowest-scoring cut, ``n`` all words of the
    language, and the score is ``2000000 a / (l + r)`` rounded down. Phrases inside a longer one that
    occurs at least 80 % as often go. Ties go to the phrase that sorts first by bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count each time; an
    empty table gives no rows; extra columns are ignored. Long texts are read in blocks that overlap
    by a phrase. Whole numbers throughout, decimals where products may pass 64 bits.
    """
    named = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    levels, totals = counted_levels(named, most_words, least)
    parts = levels.withColumn("w", F.split("phrase", " ")).withColumnRenamed("f", "a").where("words > 1")
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = parts.select("lang", "phrase", "words", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1),
        lambda k: F.struct(k.alias("k"), joined(F.lit(1), k).alias("left"), joined(k + 1, F.col("words") - k).alias("right")))).alias("c"))
    known = levels.select("lang", F.col("phrase").alias("part"), "f")
    left = known.select(F.col("lang"), F.col("part").alias("left"), F.col("f").alias("l"))
    right = known.select(F.col("lang"), F.col("part").alias("right"), F.col("f").alias("r"))
    met = cuts.select("lang", "phrase", "words", "a", "c.*").join(left, ["lang", "left"]).join(right, ["lang", "right"])
    score = F.expr(f"(CAST({SCORE_SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    inner = parts.where("words > 2").select("lang", F.col("a").alias("f"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda start: joined(start, size))))).alias("phrase"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    inside = F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(longer AS DECIMAL(19,0)) >= CAST({INSIDE_PERCENT} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))")
    stay = best.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~inside)
    rows = stay.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    first = top_k_per_key(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, ["phrase"])
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
