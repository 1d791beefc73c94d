"""Top-k, ranking and joins that hold under hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
# Rows of one key that meet in a task at most, about, in a join by shares.
SHARE_ROWS = 512


def top_k_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str],
    rank_col: str = "rank", salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows per key in ``order``, numbered from 1 in ``rank_col``.

    A key may own a large share of all rows, so each key is first cut to ``k`` rows in
    ``salts`` independent groups (chosen by a hash of ``spread``) and only the
    survivors, at most ``k * salts`` per key, meet in one window. ``order`` must be
    total. Exact: a row of the overall top k is in the top k of its own group.
    """
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        .withColumn("_pre", F.row_number().over(salted))
        .filter(F.col("_pre") <= k)
        .drop("_salt", "_pre")
        .withColumn(rank_col, F.row_number().over(final).cast("long"))
        .filter(F.col(rank_col) <= k)
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows overall; plans as a partial top-k per task and one merge."""
    return df.orderBy(*order).limit(k)


def key_shares(rows: DataFrame, key: str, most: int = SHARE_ROWS) -> DataFrame:
    """``key, _shares`` of every key with more than ``most`` rows."""
    return rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_shares")).filter("_shares > 1")


def with_share(rows: DataFrame, shares: DataFrame, key: str, spread: str) -> DataFrame:
    """Add ``_share``, by a hash of ``spread``, below the number of shares of the row's key."""
    return rows.join(shares, key, "left").withColumn("_share", F.pmod(
        F.xxhash64(spread), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares")


def join_shares(rows: DataFrame, other: DataFrame, shares: DataFrame, key: str) -> DataFrame:
    """``rows.join(other, key)`` where a key may own a large share of ``rows``.

    ``rows`` come from ``with_share``. A row of ``other`` is repeated for every share of its key,
    so a key's rows meet it in as many tasks; each pair of rows still meets once. ``other`` is not
    broadcast: rows that were prepared hold far more bytes than Spark expects of them.
    """
    dealt = other.join(shares, key, "left").withColumn("_share", F.explode(F.sequence(
        F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return rows.join(dealt.hint("merge"), [key, "_share"]).drop("_share")
