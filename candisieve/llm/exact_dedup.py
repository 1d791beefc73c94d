"""Exact duplicates through an extendible-hash index kept on shared files.

Texts meet by the 64-bit hash of their normalised bytes. First the hashes alone build a directory of
prefixes, which is doubled until no bucket holds more than ``capacity`` of them; a bucket is a range
of hashes. Then rows find their bucket through the directory's slots, copies collapse in shares, and
the owner of a bucket compares whole texts byte by byte and chains those that share a hash. Documents
find their entry by the same way: slot, bucket, hash, digest.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candisieve.llm.common import squeeze
from candisieve.session import materialize

CAPACITY = 4_096
# A text's copies reach its owner as so many rows at most, however many there are.
SHARES = 16
BITS_A_PASS = 8
MOST_BITS = 40


def prefix(key: Column, depth: Column | int) -> Column:
    """The first ``depth`` bits of a 64-bit key as a whole number; depth 0 gives 0."""
    bits = depth if isinstance(depth, Column) else F.lit(depth)
    # Shifts count modulo 64, so the key is halved once before the rest of the shift.
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(key, 1), (F.lit(63) - bits).cast("int"))


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Buckets ``depth, bucket, n_keys`` for rows with a 64-bit ``key``.

    Start with one bucket; while any holds more than ``capacity`` keys the directory doubles and the
    overfull ones split by one more bit. One pass over the keys of overfull buckets counts
    ``BITS_A_PASS`` doublings, so passes are a fraction of the final depth. Equal keys cannot be
    parted: after ``MOST_BITS`` bits a bucket stays as large as it is.
    """
    found, depth, rest = None, 0, entries.select("key")
    while True:
        step = depth + BITS_A_PASS
        fine = rest.groupBy(prefix(F.col("key"), step).alias("fine")).agg(F.count(F.lit(1)).alias("n"))
        levels = fine.select("n", F.explode(F.transform(
            F.sequence(F.lit(depth), F.lit(step)),
            lambda at: F.struct(at.alias("depth"), F.expr("fine").alias("fine")))).alias("c"))
        cell = F.call_function("shiftright", F.col("c.fine"), F.lit(step) - F.col("c.depth"))
        tally = materialize(levels.groupBy(F.col("c.depth").alias("depth"), cell.alias("bucket"))
                            .agg(F.sum("n").alias("n_keys")), "dedup-tally")
        over = tally.where(F.col("n_keys") > capacity)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
        fits = tally.where(F.col("n_keys") <= capacity).withColumn("parent", F.shiftright("bucket", 1))
        fits = fits.join(parents, ["depth", "parent"], "left_semi").unionByName(
            fits.where(F.col("depth") == 0)).drop("parent")
        found = fits if found is None else found.unionByName(fits)
        full = over.where(F.col("depth") == step)
        if step >= MOST_BITS:
            return found.unionByName(full)
        if full.isEmpty():
            return found
        rest = materialize(rest.withColumn("bucket", prefix(F.col("key"), step))
                           .join(full.select("bucket"), "bucket", "left_semi").select("key"), "dedup-overfull")
        depth = step


class Index(NamedTuple):
    """``entries`` on shared files, and the ``slots`` of the directory, of ``2 ** depth`` places, that lead to them."""

    entries: DataFrame
    slots: DataFrame
    depth: int

    def owned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``owner`` of their ``key``: the first slot of the key's bucket."""
        return _dealt(rows, self.slots.select("slot", "owner"), self.depth)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the normalised text ``norm`` and its hash ``key``."""
    return docs.withColumn("norm", squeeze(F.col("text"))).withColumn("key", F.xxhash64("norm"))


def directory_slots(buckets: DataFrame, depth: int) -> DataFrame:
    """``slot, owner, bucket, depth``: each bucket of a lower depth has several slots, the first names its owner."""
    spread = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("depth"))
    first = F.col("bucket") * spread
    return buckets.select(F.explode(F.sequence(first, first + spread - 1)).alias("slot"), first.alias("owner"), "bucket", "depth")


def _dealt(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    return rows.withColumn("slot", prefix(F.col("key"), depth)).join(slots, "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    """The index over ``doc_id, text``, written to shared files: an entry per distinct normalised text.

    ``bucket`` and ``depth`` name the bucket, ``owner`` its first slot, ``key`` the hash, ``chain`` the
    place among texts that share the hash, ``text_sha256`` the digest, ``keep_id`` the smallest doc_id,
    ``group_size`` the number of rows. Copies collapse before either shuffle, so a text that owns a
    third of all rows reaches its owner as ``SHARES`` rows. Two texts with the same hash and digest
    raise an error.
    """
    rows = keyed(docs)
    buckets = directory(materialize(rows.select("key").distinct(), "dedup-keys"), capacity)
    depth = buckets.agg(F.max("depth")).first()[0] or 0
    slots = materialize(directory_slots(buckets, depth), "dedup-slots")
    shares = rows.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES))).groupBy("key", "norm", "share").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("share")
    # From here on all rows of a bucket are in one task: the grouping and the chains need no further shuffle.
    grouped = _dealt(shares, slots, depth).repartition("owner").groupBy("owner", "bucket", "depth", "key", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    entries = grouped.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")
    chain = Window.partitionBy("owner", "key").orderBy("text_sha256")
    same = F.lag("text_sha256").over(chain) == F.col("text_sha256")
    held = materialize(entries.select(
        "owner", "bucket", "depth", "key", F.row_number().over(chain).alias("chain"),
        F.when(same, F.raise_error(F.lit("two texts share hash and digest"))).otherwise(F.col("text_sha256")).alias("text_sha256"),
        "keep_id", "group_size"), "dedup-index")
    return Index(held, slots, depth)


def exact_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The entries of ``build_index``."""
    return build_index(docs, capacity).entries


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain``.

    Null texts count as empty and equal each other. A null doc_id is larger than any other; of rows
    that repeat both text and doc_id one is kept. An empty table gives no rows. Extra columns are
    ignored.
    """
    docs = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    index = build_index(docs, capacity)
    # Repeats are numbered before the join, so that the join alone decides how its rows are dealt and
    # a hash with many rows can be split.
    again = F.row_number().over(Window.partitionBy("doc_id", "key", "text_sha256").orderBy(F.lit(0)))
    probe = keyed(docs).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")).withColumn("again", again)
    return index.owned(probe).join(index.entries, ["owner", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("again") == 1)).alias("kept"),
        "text_sha256", "bucket", "chain")


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text.

    Of rows that repeat both text and doc_id the one stays whose columns hash lowest, so reruns agree.
    """
    slim = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"))
    index = build_index(slim, capacity)
    # Rows travel whole in one column, so their names cannot clash with those of the index.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = keyed(docs.select(row.alias("_row"), F.col("`text`").alias("text"), F.xxhash64(F.to_json(row)).alias("_mark")))
    held = index.owned(held.select("_row", "_mark", "key", F.sha2("norm", 256).alias("text_sha256"), F.col("_row")["doc_id"].alias("_id")))
    kept = index.entries.select(F.col("owner").alias("_owner"), F.col("key").alias("_key"), F.col("text_sha256").alias("_sha"), "keep_id")
    # The id is part of the join's key, so the copies of a hot text are not sent to one task.
    stay = held.join(kept, (F.col("owner") == F.col("_owner")) & (F.col("key") == F.col("_key"))
                     & (F.col("text_sha256") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("keep_id")))
    once = Window.partitionBy("text_sha256", "_id").orderBy("_mark")
    return stay.withColumn("_again", F.row_number().over(once)).where("_again = 1").select("_row.*")
