"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols are its characters; an agenda of adjacent pairs, ordered by the score of the piece a
pair would make and then by place, merges them until no pair makes a piece. Texts are cut where no
piece of the vocabulary could join both sides, so equal cuts are encoded once; the agendas of many
short cuts advance together, one row of an array each, and a long cut has a heap. Every new cut is
checked against the sentencepiece library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SHORT, NEVER = 48, np.int32(2**31 - 1)
CODE_POINTS = 0x110000
MOST_KEPT = 400_000
CHECKED_AT_ONCE = 20_000
ROWS_AT_ONCE = 5_000


class PieceEncoder:
    """Encodes with the pieces and scores of a model file; decodes with the library."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        # Equal scores rank alike.
        levels = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {piece: levels[sp.get_score(i)] for piece, i in self.ids.items()}
        # A symbol is a piece's id, or the number of pieces plus the code point of a character that is none.
        self.size, self.width = size, size + CODE_POINTS
        self.symbol_of = np.arange(size, self.width)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        number = lambda part: self.ids[part] if part in self.ids else int(self.symbol_of[ord(part)]) if len(part) == 1 else None
        pairs = sorted((a * self.width + b, self.rank[piece], i) for piece, i in self.ids.items() for cut in range(1, len(piece))
                       if (a := number(piece[:cut])) is not None and (b := number(piece[cut:])) is not None)
        self.pair_keys = np.array([p[0] for p in pairs], np.int64)
        self.pair_ranks, self.pair_made = (np.array([p[k] for p in pairs], np.int32) for k in (1, 2))
        self.bytes = {sp.id_to_piece(i): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        # Two characters that no piece holds side by side are never merged: there a text can be cut.
        joined = {piece[i: i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        alone = [c for c in "\n\t\r\x00\x01" if not any(c in pair for pair in joined)]
        self.separator = alone[0]
        letters = {c for pair in joined for c in pair if c.isalpha()}
        signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        ends = [c for c in signs if not any(a + c in joined for a in letters)]
        if any(a != SPACE and b == SPACE for a, b in joined):
            raise ValueError("pieces with a space inside are not supported")
        apart, after = "".join(map(re.escape, alone)), "".join(map(re.escape, ends))
        # A character alone, or spaces and what follows; letters end before a sign that joins none.
        self.cuts = re.compile(
            rf"[{apart}]|{SPACE}*[^\W\d_]+(?=[{after}])|{SPACE}+[^{SPACE}{apart}]*|[^{SPACE}{apart}]+")
        self.between = self.packed(self.spelled(self.separator))
        self.known: dict[str, bytes] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge adjacent symbols in the order of the agenda until no pair makes a piece."""
        rank = self.rank
        n = len(symbols)
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
        if not agenda:
            return symbols
        heapify(agenda)
        symbols = list(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            _, i, made = heappop(agenda)
            j = right[i]
            # An entry is stale if one of its symbols has been merged since.
            if j >= n or not symbols[i] or len(symbols[i]) + len(symbols[j]) != len(made) or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j] = made, ""
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                pair = made + symbols[after]
                if pair in rank:
                    heappush(agenda, (rank[pair], i, pair))
            before = left[i]
            if before >= 0:
                pair = symbols[before] + made
                if pair in rank:
                    heappush(agenda, (rank[pair], before, pair))
        return [s for s in symbols if s]

    def spelled(self, symbol: str) -> list[int]:
        """The id of a piece; what is no piece falls back to its bytes."""
        if symbol in self.ids:
            return [self.ids[symbol]]
        return [self.bytes[f"<0x{b:02X}>"] for b in symbol.encode()] if self.bytes else [self.unknown]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that two symbols make; the rank is ``NEVER`` if they make none."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NEVER), self.pair_made[at]

    def short_ids(self, cuts: list[str]) -> list[bytes]:
        """Packed ids of cuts of similar length: one agenda a row, all rows advance together.

        Row by row the first entry of the smallest rank is merged, as in ``merge``; rows without
        a pair left are set aside.
        """
        sizes = np.array([len(c) for c in cuts])
        wide = int(sizes.max())
        points = np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)
        symbols = np.full((len(cuts), wide), -1, np.int64)
        columns = np.arange(wide)
        symbols[columns < sizes[:, None]] = self.symbol_of[points]
        ranks, made = np.full(symbols.shape, NEVER, np.int32), np.zeros(symbols.shape, np.int32)
        ranks[:, :-1], made[:, :-1] = self.look_up(symbols[:, :-1], symbols[:, 1:])
        live, done = np.arange(len(cuts)), np.full((len(cuts), wide), -1, np.int64)
        while len(live):
            best = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            going = ranks[rows, best] != NEVER
            if not going.all():
                done[live[~going], : symbols.shape[1]] = symbols[~going]
                live, best, symbols, ranks, made = live[going], best[going], symbols[going], ranks[going], made[going]
                rows = np.arange(len(live))
            if not len(live):
                break
            symbols[rows, best] = made[rows, best]
            after = np.arange(symbols.shape[1] - 1) > best[:, None]
            symbols = np.where(after, symbols[:, 1:], symbols[:, :-1])
            # The pair of the two that merged goes; the one to its right moves up.
            after |= np.arange(symbols.shape[1]) == best[:, None]
            ranks, made = np.where(after, ranks[:, 1:], ranks[:, :-1]), np.where(after, made[:, 1:], made[:, :-1])
            for place in (best - 1, best):
                ok = np.flatnonzero((place >= 0) & (place + 1 < symbols.shape[1]))
                r, at = rows[ok], place[ok]
                ranks[r, at], made[r, at] = self.look_up(symbols[r, at], symbols[r, at + 1])
        odd = (done >= self.size).any(axis=1)
        packed = done[done >= 0].astype("<u4").tobytes()
        ends = 4 * np.cumsum((done >= 0).sum(axis=1))
        out = [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for k in np.flatnonzero(odd):
            names = [self.library.id_to_piece(s) if s < self.size else chr(s - self.size) for s in done[k][done[k] >= 0].tolist()]
            out[k] = self.packed([i for name in names for i in self.spelled(name)])
        return out

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def cut_ids(self, cuts: list[str]) -> list[bytes]:
        """Packed ids of every cut."""
        out: dict[int, bytes] = {}
        order = sorted(range(len(cuts)), key=lambda k: len(cuts[k]))
        short = [k for k in order if len(cuts[k]) <= SHORT]
        for at in range(0, len(short), ROWS_AT_ONCE):
            some = short[at: at + ROWS_AT_ONCE]
            out.update(zip(some, self.short_ids([cuts[k] for k in some])))
        for k in order[len(short):]:
            out[k] = self.packed([i for symbol in self.merge(list(cuts[k])) for i in self.spelled(symbol)])
        return [out[k] for k in range(len(cuts))]

    def learn(self, cuts: set[str]) -> None:
        """Encode cuts not seen yet and check them against the library, many at once."""
        fresh = [c for c in cuts if c not in self.known]
        if len(self.known) + len(fresh) > MOST_KEPT:
            self.known.clear()
            fresh = list(cuts)
        start = (self.packed([self.ids[SPACE]]) if SPACE in self.ids else b"") + self.between
        for at in range(0, len(fresh), CHECKED_AT_ONCE):
            some = fresh[at: at + CHECKED_AT_ONCE]
            ids = self.cut_ids(some)
            shown = self.separator + self.separator.join(some).replace(SPACE, " ")
            if self.packed(self.library.encode(shown)) != start + self.between.join(ids):
                raise ValueError("the agenda and the sentencepiece library differ")
            self.known.update(zip(some, ids))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, with begin and end, as little-endian 32-bit integers."""
        split = [self.cuts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.begin, self.end))
        out, lo = [], 0
        while lo < len(split):
            # As many texts as have at most the kept number of cuts, one at least.
            cuts, hi = set(split[lo]), lo + 1
            while hi < len(split) and len(cuts) + len(split[hi]) <= MOST_KEPT // 2:
                cuts.update(split[hi])
                hi += 1
            self.learn(cuts)
            for one in split[lo:hi]:
                out.append(begin + b"".join([self.known[c] for c in one]) + end)
            lo = hi
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a model file; a worker that lives on keeps it and the cuts it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids with begin and end, packed as little-endian 32-bit integers, and the text they decode to.

    Null counts as empty; an empty text has only begin and end. A very long text is encoded whole.
    Repeated rows are encoded each; an empty table gives no rows. ``model`` is a path on every
    executor. Ids that differ from the library's raise an error.
    """
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids binary, decoded string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model)
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                ids = encoder.encode_many(part.column(1).to_pylist())
                back = [encoder.decode(one) for one in ids] if decoded else [None] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(one) // 4 for one in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(encode, schema)
