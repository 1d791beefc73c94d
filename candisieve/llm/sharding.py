"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key: a hash of the text, then a hash of the id, so equal texts lie side by
side. A sample of keys, drawn by size, gives quantile boundaries that part the keys into ranges;
ranges that turn out overfull are sampled again and subdivided. The exact sums of all ranges say
which of them hold the borders of the shards, and only those are searched for the border's row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candisieve.session import materialize

LAW = "bytes"
SHARDS = 8
# Ranges have about so many rows, draws a range so many sampled keys; few rows are still parted for each shard.
RANGE_ROWS, RANGES_A_SHARD, DRAWS = 500_000, 4, 16
# Equal texts stay together up to this part of a shard; larger groups are cut between their rows.
GROUP_PART = 64
# Hexadecimal digits of a key: those of the text, of the id, and of a salt that parts repeated rows.
TEXT_DIGITS, ID_DIGITS, SALT_DIGITS = 16, 16, 12
AFTER = "g"  # sorts after every digit


@dataclass(frozen=True)
class Cut:
    """A border between shards: keys above ``key``, or also those equal to it, belong to the higher one."""

    key: str
    equal_above: bool

    def above(self, key: Column) -> Column:
        return key >= self.key if self.equal_above else key > self.key


def digest(value: Column, digits: int) -> Column:
    return F.substring(F.md5(value.cast("binary")), 1, digits)


def record_key(key: Column, text: Column) -> Column:
    """The place of a record in the order; the salt only parts rows that repeat both id and text."""
    return F.concat(
        digest(F.coalesce(text, F.lit("")), TEXT_DIGITS),
        digest(F.coalesce(key.cast("string"), F.lit("")), ID_DIGITS),
        digest(F.monotonically_increasing_id().cast("string"), SALT_DIGITS))


def sized_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, key``, written once: the texts are read in this pass alone."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return materialize(docs.select(
        F.col(f"`{key}`").alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        record_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("key")), "shard-keys")


def with_range(keys: DataFrame, boundaries: list[str]) -> DataFrame:
    """Adds ``range``: the number of boundaries up to the row's key."""
    width = TEXT_DIGITS + ID_DIGITS + SALT_DIGITS
    edges = np.array(boundaries, f"S{width}")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array(batch.column("key").to_pylist(), f"S{width}")
            found = np.searchsorted(edges, own, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "range"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return keys.mapInArrow(locate, f"{fields}, range int")


def _draws(keys: DataFrame, expected: Column, pass_no: int) -> list[tuple[str, int]]:
    """Sampled keys with the number of draws that hit them: ``expected`` a row, rounded at random."""
    chance = F.pmod(F.xxhash64("key", F.lit(pass_no)), F.lit(1 << 30)) / float(1 << 30)
    hit = keys.select("key", F.floor(expected + chance).alias("draws")).where("draws > 0")
    return sorted((r.key, r.draws) for r in hit.collect())


def _quantiles(sample: list[tuple[str, int]]) -> set[str]:
    """Every key at which another ``DRAWS`` draws are full."""
    found, seen = set(), 0
    for key, draws in sample:
        if seen // DRAWS != (seen + draws) // DRAWS:
            found.add(key)
        seen += draws
    return found


def split_ranges(keys: DataFrame, shards: int = SHARDS) -> tuple[list[str], list]:
    """Boundaries of the ranges, and the ``range, rows, bytes`` of each range that has rows, in order.

    A row is drawn by its share of all bytes and of all rows, so that a range is bounded in both. The
    sample holds about ``DRAWS`` keys a range; it and the list of ranges are what the driver gets, a
    key for every ``RANGE_ROWS / DRAWS`` rows. A range of over twice the rows it should have is
    sampled again by rows alone and subdivided, until none is left or no key parts it further.
    """
    n, total = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return [], []
    ranges = max(shards * RANGES_A_SHARD, -(-n // RANGE_ROWS))
    share = (F.col("size") / float(total) + 1.0 / n) / 2
    boundaries = _quantiles(_draws(keys, share * float(DRAWS * ranges), 0))
    passes = 0
    while True:
        edges = sorted(boundaries)
        ranged = with_range(keys.select("key", "size"), edges)
        held = sorted(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect())
        over = [r["range"] for r in held if r["rows"] > max(2 * n / ranges, 2 * DRAWS)]
        passes += 1
        fresh = _quantiles(_draws(ranged.where(F.col("range").isin(over)), F.lit(DRAWS * ranges / n), passes)) - boundaries if over else set()
        if not fresh:
            return edges, held
        boundaries |= fresh


def find_cuts(keys: DataFrame, boundaries: list[str], held: list, shards: int = SHARDS) -> list[Cut]:
    """The borders between shards, in order.

    A row belongs to the shard that the middle of its bytes falls into. So only the row that spans a
    border is needed, which lies in one known range. If the equal texts around it are together at
    most ``1 / GROUP_PART`` of a shard, the middle of all of them decides, and they stay together.
    """
    total = sum(r["bytes"] for r in held)
    starts, at = {}, 0
    for r in held:
        starts[r["range"]] = at
        at += r["bytes"]
    # Offsets are compared after multiplying by the number of shards, in whole numbers.
    targets = [total * i for i in range(1, shards)]
    spans = {r["range"]: starts[r["range"]] * shards for r in held}
    near = sorted({max((k for k in spans if spans[k] <= t), key=spans.get) for t in targets})
    order = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.create_map(*[F.lit(x) for k in near for x in (k, starts[k])])
    rows = (with_range(keys.select("key", "size"), boundaries).where(F.col("range").isin(near))
            .withColumn("offset", begin[F.col("range")] + F.coalesce(F.sum("size").over(order), F.lit(0))))
    crossing = F.lit(False)
    for t in targets:
        crossing = crossing | ((F.col("offset") * shards <= t) & ((F.col("offset") + F.col("size")) * shards > t))
    spanning = rows.where(crossing).collect()
    groups = sorted({r["key"][:TEXT_DIGITS] for r in spanning})
    text = F.substring("key", 1, TEXT_DIGITS)
    sizes = {r["text"]: r["bytes"] for r in keys.where(text.isin(groups)).groupBy(text.alias("text")).agg(
        F.sum("size").alias("bytes")).collect()}
    before = {r["key"]: r["bytes"] for r in spanning for r in [_before(keys, r["key"])]}
    cuts = []
    for t in targets:
        row = next(r for r in spanning if r["offset"] * shards <= t < (r["offset"] + r["size"]) * shards)
        group = row["key"][:TEXT_DIGITS]
        if sizes[group] * shards * GROUP_PART <= total:
            middle = 2 * (row["offset"] - before[row["key"]]) + sizes[group]
            cuts.append(Cut(group, True) if middle * shards >= 2 * t else Cut(group + AFTER, False))
        else:
            cuts.append(Cut(row["key"], (2 * row["offset"] + row["size"]) * shards >= 2 * t))
    return cuts


def _before(keys: DataFrame, key: str) -> dict:
    """The bytes of the rows with the same text whose keys come before ``key``."""
    own = F.substring("key", 1, TEXT_DIGITS) == key[:TEXT_DIGITS]
    size = keys.where(own & (F.col("key") < key)).agg(F.sum("size")).first()[0]
    return {"key": key, "bytes": size or 0}


def shard_of(key: Column, cuts: list[Cut]) -> Column:
    return sum((cut.above(key).cast("int") for cut in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Shards 0 to ``shards - 1`` are near equal in bytes (a text's UTF-8 bytes plus 1), off by half a
    document or half a small group of equal texts at either end. ``slot`` numbers a shard's rows from
    0 in the order of the keys. ``grown_shard`` is null, as shards are not kept when their number
    changes. Null texts are empty and null ids a value of their own; rows that repeat id and text are
    interchangeable; a document larger than a shard fills several and leaves the others empty; an
    empty table gives no rows; extra columns are ignored. Samples only choose the ranges, so the
    result does not depend on them.
    """
    keys = sized_keys(docs, key, text)
    boundaries, held = split_ranges(keys, shards)
    cuts = find_cuts(keys, boundaries, held, shards) if held else []
    dealt = with_range(keys, boundaries).withColumn("shard", shard_of(F.col("key"), cuts))
    parts = dealt.groupBy("range", "shard").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range and shard meets here.
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("range", "shard", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range", "shard").orderBy("key")
    placed = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(first, ["range", "shard"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write whole records to ``{path}/shard=N``, each file a range of keys in order.

    Every column is kept; one that is called ``shard`` must be renamed first.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("records have a column 'shard' already")
    keys = sized_keys(docs, key, text)
    boundaries, held = split_ranges(keys, shards)
    cuts = find_cuts(keys, boundaries, held, shards) if held else []
    held_key = next(c for c in ("_key" + "_" * k for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    (docs.withColumn(held_key, record_key(F.col(f"`{key}`"), F.col(f"`{text}`")))
     .withColumn("shard", shard_of(F.col(held_key), cuts))
     .repartitionByRange("shard", held_key).sortWithinPartitions("shard", held_key).drop(held_key)
     .write.partitionBy("shard").parquet(path))
