"""Mix sources to target weights along a curriculum that changes over the run.

Every source has a weight and a slope: at time t of the run (0 to 1) it is drawn with density
``1 + slope * (2 t - 1)``. The integral of that schedule is the source's cumulative demand; the
source's documents, in a fixed random order and repeated as often as the target asks, fill that
demand, and inverting the integral gives each copy its training position. The result is sorted by
position over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candisieve.llm.common import WORD
from candisieve.session import materialize

# Weights of the sources in the order of their names, and the slopes of their schedules, both repeating.
WEIGHTS = (3, 1, 2)
SLOPES = (0.5, -0.5, 0.0)
SHARE, MOST_PASSES = 1.5, 2
SLICE_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(key: Column, text: Column) -> Column:
    """The place of a row within its source; rows that repeat or lack the key are parted by their text."""
    digest = lambda value: F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.md5(F.concat(digest(key), digest(text)).cast("binary"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES,
    share: float = SHARE, passes: int = MOST_PASSES,
) -> DataFrame:
    """``source, source_size, weight, slope, target`` from one row per source (``source, source_size``).

    Targets share ``share`` times all sizes by weight; what exceeds ``passes`` times a source's size
    is dealt again to the others by weight. That ends at one level: sources whose ratio of limit to
    weight lies below it are full, the others get weight times level. Sorted by that ratio, running
    sums of whole numbers find the level. The windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(by_name) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))
    named = sizes.select("source", "source_size", pick(weights).cast("long").alias("weight"),
                         pick([float(s) for s in slopes]).alias("slope"))
    limited = named.withColumns({
        "bound": F.col("source_size") * passes,
        "ratio": F.col("source_size") * passes / F.col("weight"),
    })
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("bound").over(by_ratio), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    reached = limited.withColumn("level", level)
    # Levels rise up to the first source that its level does not fill, and fall from there on.
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    return (reached.withColumn("final", final)
            .select("source", "source_size", "weight", "slope",
                    F.when(F.col("final").isNull() | (F.col("weight") * F.col("final") > F.col("bound")),
                           F.col("bound").cast("double"))
                    .otherwise(F.col("weight") * F.col("final")).alias("target")))


def when_reached(part: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand is ``part`` (0 to 1) of its target.

    The demand is the integral of ``1 + slope (2 t - 1)``, which is ``(1 - slope) t + slope t^2``.
    """
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * part)
    return F.when(slope == 0, part).otherwise((root - (1 - slope)) / (2 * slope)) + F.lit(0.0)  # no negative zero


def place_sources(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES,
    share: float = SHARE, passes: int = MOST_PASSES,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies, position, last_position, positions``.

    ``copies`` counts the passes that take words from the document and ``taken`` counts the words the mix takes from the document over all passes; the last pass ends
    inside the document at which the target is met. ``position`` is the training time of the first
    copy, ``last_position`` that of the last, null where nothing is taken, and ``positions`` those of all.

    Order within a source is by a hash of key and text, then the key, then the size, so reruns agree:
    rows that are still equal are the same in every column. Null sources form
    one source after all others; null or empty texts have size 0 and are taken 0 times; repeated
    rows count as documents of their own; an empty table gives no rows.

    A source's running sum never meets in one task: rows are dealt into slices of the hash range of
    about ``SLICE_ROWS`` rows, summed, and only the sums of the slices are accumulated per source.
    """
    named = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"),
                        word_count(F.col(f"`{text}`")).alias("size"), order_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("rank"))
    sized = materialize(named, "mix-sizes")
    slices = max(1, sized.count() // SLICE_ROWS)
    unit = F.conv(F.substring("rank", 1, 8), 16, 10).cast("long")
    sliced = sized.withColumn("slice", F.floor(unit * F.lit(slices) / F.lit(2**32)).cast("long"))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, slopes, share, passes)
    plan = (starts.join(targets, starts["source"].eqNullSafe(targets["source"]))
            .select(starts["source"].alias("s"), starts["slice"].alias("c"), "start", "source_size", "slope", "target"))
    inside = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    running = sliced.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = (running.join(plan, running["source"].eqNullSafe(plan["s"]) & (running["slice"] == plan["c"]))
              .withColumn("offset", F.col("start") + F.col("ahead"))
              .withColumn("wanted", F.round("target").cast("long")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("wanted") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.least(F.col("size"), F.greatest(F.lit(0), F.col("wanted") - F.col("full") * F.col("source_size") - F.col("offset")))
    counted = placed.withColumn("full", full.cast("long")).withColumn("taken", F.col("full") * F.col("size") + rest)
    copies = F.col("full") + F.when(F.col("taken") > F.col("full") * F.col("size"), 1).otherwise(0)
    at = lambda nth: when_reached(
        F.least(F.lit(1.0), (nth * F.col("source_size") + F.col("offset")) / F.col("target")), F.col("slope"))
    return (counted.withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "taken", "copies",
                    F.when(F.col("taken") > 0, at(F.lit(0))).alias("position"),
                    F.when(F.col("taken") > 0, at(F.col("copies") - 1)).alias("last_position"),
                    F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), at)).alias("positions")))


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``place_sources`` sorted by position over ranges; documents that are not taken come last.

    The id is part of the ranges, so documents without a position do not meet in one task.
    """
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return place_sources(docs, **settings).drop("positions").repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix serves them: a row for each copy, all columns, sorted by position over ranges.

    Documents stay whole: the one at which a source's target is met is served in its last pass if at
    least half of it is taken. Rows that repeat a doc_id are served equally often.
    """
    mix = place_sources(docs, **settings)
    whole = F.floor((F.col("taken") + F.col("size") / 2) / F.greatest("size", F.lit(1))).cast("int")
    plan = mix.groupBy("doc_id").agg(F.max(whole).alias("_times"), F.min("position").alias("_first"), F.max("last_position").alias("_last"),
                                     F.max_by("positions", "last_position").alias("_all"))
    plan = plan.withColumnRenamed("doc_id", "_key").where("_times > 0")
    # Rows travel whole in one column, so their names cannot clash with those of the plan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    served = rows.join(plan, F.col("_row")["doc_id"].eqNullSafe(F.col("_key")))
    # One position for each pass; rows that repeat a doc_id may be in fewer passes than the id is served.
    nth = lambda i: F.when(i == 0, F.col("_first")).otherwise(F.coalesce(F.get("_all", i), F.col("_last")))
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.col("_times") - 1), nth))
    placed = served.select("_row", "_key", copies.alias("_at"))
    return placed.repartitionByRange("_at").sortWithinPartitions("_at", "_key").select("_row.*")
