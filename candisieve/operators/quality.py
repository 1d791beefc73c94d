"""Checks of a ranked list as written: violations as rows.

``sub`` holds the cells as text: ``row_num, n_cells, candidate_id, rank, score`` and the
key columns in ``keys`` that tell lists apart. Each check returns ``keys, rule, row_key``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candisieve.functions.fixed_values import ID_PATTERN
from candisieve.functions.text import strip

HEADER = ["candidate_id", "rank", "score", "reasoning"]
LIST_LENGTH = 100
RANK_RANGE = 10_000
_INTEGER = r"^(0|-?[1-9][0-9]*)$"
_FLOAT = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"


def _cell(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def _whole(sub: DataFrame) -> DataFrame:
    """Rows with the right number of cells; only these are looked into."""
    return sub.filter(F.col("n_cells") == len(HEADER))


def _rank() -> Column:
    return F.when(_cell("rank").rlike(_INTEGER), F.expr("try_cast(trim(rank) AS bigint)"))


def _score() -> Column:
    text = F.lower(_cell("score"))
    named = F.regexp_replace(text, "^([+-]?)inf$", "$1infinity")
    return F.when(_cell("score").rlike(_FLOAT), named.try_cast("double"))


def _report(rows: DataFrame, keys: Sequence[str], rule: str, row_key: Column) -> DataFrame:
    return rows.select(*keys, F.lit(rule).alias("rule"), row_key.cast("string").alias("row_key"))


def _repeats(rows: DataFrame, same: Sequence[str]) -> DataFrame:
    """Rows behind the first one with equal ``same``; the first is found by partial aggregation."""
    first = rows.groupBy(*same).agg(F.min("row_num").alias("_first"))
    return rows.join(first, list(same)).filter("row_num > _first")


def check_header(headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The header line, ``keys, header`` with its cells as an array, is exactly ``HEADER``.

    A list without a header line has null there, which is a fault too.
    """
    wanted = F.array(*[F.lit(c) for c in HEADER])
    return _report(headers.filter(~F.col("header").eqNullSafe(wanted)), keys, "header", F.coalesce(
        F.array_join("header", ",", ""), F.lit("")))


def check_shape(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exactly ``LIST_LENGTH`` rows, each of four cells."""
    counts = sub.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") != LIST_LENGTH)
    cells = sub.filter(F.col("n_cells") != len(HEADER))
    return _report(counts, keys, "row_count", F.col("n")).unionByName(
        _report(cells, keys, "cell_count", F.col("row_num")))


def check_ids(sub: DataFrame, keys: Sequence[str], id_pattern: str = ID_PATTERN) -> DataFrame:
    """Id given, well formed, and not used before."""
    rows = _whole(sub).withColumn("_id", _cell("candidate_id"))
    formed = rows.filter(F.col("_id").rlike(id_pattern))
    repeated = _repeats(formed, [*keys, "_id"])
    return reduce(DataFrame.unionByName, [
        _report(rows.filter("_id = ''"), keys, "id_missing", F.col("row_num")),
        _report(rows.filter((F.col("_id") != "") & ~F.col("_id").rlike(id_pattern)), keys, "id_pattern", F.col("row_num")),
        _report(repeated, keys, "id_duplicate", F.col("row_num"))])


def check_ranks(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank a plain integer from 1 to 100, each exactly once."""
    rows = _whole(sub).withColumn("_rank", _rank())
    inside = F.col("_rank").between(1, LIST_LENGTH)
    good = rows.filter(inside)
    every = sub.select(*keys).distinct().withColumn(
        "_rank", F.explode(F.sequence(F.lit(1), F.lit(LIST_LENGTH)).cast("array<bigint>")))
    absent = every.join(good.select(*keys, "_rank"), [*keys, "_rank"], "left_anti")
    return reduce(DataFrame.unionByName, [
        _report(rows.filter("_rank IS NULL"), keys, "rank_integer", F.col("row_num")),
        _report(rows.filter(~inside), keys, "rank_range", F.col("row_num")),
        _report(_repeats(good, [*keys, "_rank"]), keys, "rank_duplicate", F.col("row_num")),
        _report(absent, keys, "rank_missing", F.col("_rank"))])


def check_scores(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score a number."""
    return _report(_whole(sub).filter(_score().isNull()), keys, "score_float", F.col("row_num"))


def _by_rank(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readable rows beside the next one in rank order.

    A list may be of any length, so it is cut into ranges of ``RANK_RANGE`` ranks; rows meet their
    successor inside a range, and the last row of a range the first one of the next.
    """
    rows = _whole(sub).select(
        *keys, "row_num", _rank().alias("r"), _score().alias("s"), _cell("candidate_id").alias("id")
    ).filter("r IS NOT NULL AND s IS NOT NULL AND id <> ''").withColumn("part", F.floor(F.col("r") / RANK_RANGE))
    order = Window.partitionBy(*keys, "part").orderBy("r", "row_num")
    inside = rows.withColumn("next_s", F.lead("s").over(order)).withColumn("next_id", F.lead("id").over(order))
    place, row = F.struct("r", "row_num"), F.struct("r", "s", "id")
    ends = rows.groupBy(*keys, "part").agg(F.min_by(row, place).alias("head"), F.max_by(row, place).alias("tail"))
    ends = ends.withColumn("after", F.lead("head").over(Window.partitionBy(*keys).orderBy("part")))
    between = ends.select(*keys, "tail.*", F.col("after.s").alias("next_s"), F.col("after.id").alias("next_id"))
    wanted = [*keys, "r", "s", "id", "next_s", "next_id"]
    return inside.filter("next_id IS NOT NULL").select(*wanted).unionByName(between.select(*wanted))


def check_monotonic(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores do not rise with rank."""
    return _report(_by_rank(sub, keys).filter("s < next_s"), keys, "score_order", F.col("r"))


def check_ties(sub: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal scores in id order. Ranking itself breaks ties by behaviour first, so
    this check may report a list that the ranking wrote."""
    return _report(_by_rank(sub, keys).filter("s = next_s AND id > next_id"), keys, "tie_order", F.col("r"))


CHECKS = [check_shape, check_ids, check_ranks, check_scores, check_monotonic, check_ties]


def violations(sub: DataFrame, headers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All checks, as one table. ``headers`` holds the header line of every list."""
    return reduce(DataFrame.unionByName, [check_header(headers, keys), *(check(sub, keys) for check in CHECKS)])
