"""Exact vector search that skips: vectors in cells around centres, bounded by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candisieve.functions.pruned import pruned_topk
from candisieve.functions.topk import top_k, top_k_per_key
from candisieve.functions.vectors import SCORE_DIGITS
from candisieve.session import materialize

# Queries of one task, vectors of one block, scores a task holds at a time, and centres at most.
BLOCK_QUERIES, BLOCK_VECTORS, MOST_SCORES, MOST_CENTRES = 2_048, 4_096, 4 << 20, 1_024


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.nonzero(scores >= cut)[0]
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _search(query_ids, matrix: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block of vectors for every query, ``MOST_SCORES`` scores at a time."""
    step = max(1, MOST_SCORES // max(1, len(ids)))
    frames = []
    for lo in range(0, len(query_ids), step):
        scores = np.round(matrix[lo: lo + step] @ vectors.T, SCORE_DIGITS)
        best = [_best(row, ids, k) for row in scores]
        frames.append(pd.DataFrame({
            "job_id": np.repeat(query_ids[lo: lo + step], [len(b) for b in best]), "id": ids[np.concatenate(best)],
            "score": np.concatenate([row[b] for row, b in zip(scores, best)])}))
    return pd.concat(frames)


def cells(items: DataFrame, n: int, block_rows: int = BLOCK_VECTORS) -> tuple[DataFrame, DataFrame]:
    """``block, id, v`` and ``block, centre, radius`` of ``id, v``, both written once.

    Centres are up to ``MOST_CENTRES`` vectors, those of the smallest id hash, and every vector goes to
    its nearest one. A cell of more than ``block_rows`` vectors is cut by a hash of the id into
    blocks with radii of their own, so a hot cell fills no task.
    """
    wanted = min(MOST_CENTRES, math.ceil(n / block_rows) * 4)
    picked = top_k(items.withColumn("h", F.xxhash64("id")), [F.asc("h"), F.asc("id")], max(1, wanted)).select("v").collect()
    centres = np.unique(np.array([r["v"] for r in picked], np.float64).reshape(len(picked), -1), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = _stack(batch["v"])
                cell = np.argmax(v @ centres.T - np.square(centres).sum(axis=1) / 2, axis=1)
                yield batch.assign(cell=cell, gap=np.linalg.norm(v - centres[cell], axis=1))

    schema = T.StructType([*items.schema.fields, T.StructField("cell", T.LongType()), T.StructField("gap", T.DoubleType())])
    placed = materialize(items.mapInPandas(assign, schema), "vector-cells")
    parts = {r["cell"]: math.ceil(r["count"] / block_rows) for r in placed.groupBy("cell").count().collect()}
    per = F.create_map(*[F.lit(x).cast("long") for c, p in parts.items() for x in (c, p)])[F.col("cell")] if parts else F.lit(1)
    rows = placed.withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), per))
    balls = rows.groupBy("block", "cell").agg(F.max("gap").alias("radius"))
    spots = items.sparkSession.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell long, centre array<double>")
    return rows.select("block", "id", "v"), materialize(balls.join(spots, "cell").select("block", "centre", "radius"), "vector-balls")


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str = "embedding",
    query_id: str = "job_id", query_vector: str = "embedding", block_rows: int = BLOCK_VECTORS,
) -> tuple[DataFrame, DataFrame]:
    """The k vectors of highest inner product per query, and ``job_id, blocks, met``.

    Exact over all vectors: no vector of a block lies farther than its radius from its centre, so its
    inner product with q is at most that of the centre plus radius times the length of q. Blocks
    whose bound stays under the k-th score are neither dealt out nor multiplied. Null vectors take no
    part; ties go to the smaller id.
    """
    items = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    wanted = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("job_id"), F.col(query_vector).cast("array<double>").alias("q"))
    n = items.count()
    buckets = max(1, math.ceil(wanted.count() / BLOCK_QUERIES))
    job = T.StructField("job_id", wanted.schema["job_id"].dataType)
    found = T.StructType([job, T.StructField("id", items.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    bounded = T.StructType([job, T.StructField("block", T.LongType()), T.StructField("bound", T.DoubleType())])

    def bucket() -> Column:
        return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"job_id": [], "block": [], "bound": []})
        q, centre, radius = _stack(right["q"]), _stack(left["centre"]), left["radius"].to_numpy()
        top = q @ centre.T + np.linalg.norm(q, axis=1)[:, None] * radius
        return pd.DataFrame({"job_id": np.repeat(right["job_id"].to_numpy(), len(left)), "block": np.tile(left["block"].to_numpy(), len(right)),
                             "bound": (top + 1e-12 * np.abs(top)).ravel()})

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"job_id": [], "id": [], "score": []})
        return _search(right["job_id"].to_numpy(), _stack(right["q"]), left["id"].to_numpy(), _stack(left["v"]), k)

    def meet(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(wanted, "job_id").withColumn("bucket", bucket())
        held = rows.join(pairs.select("block", bucket().alias("bucket")).distinct(), "block")
        return held.groupBy("block", "bucket").cogroup(asked.groupBy("block", "bucket")).applyInPandas(kernel, found)

    if n <= block_rows:
        # All vectors are one block, which every query meets.
        rows = items.withColumn("block", F.lit(0).cast("long"))
        pairs = wanted.select("job_id", F.lit(0).cast("long").alias("block"))
        best = top_k_per_key(meet(pairs), ["job_id"], [F.desc("score"), F.asc("id")], k, ["id"])
        report = wanted.select("job_id", F.lit(1).cast("long").alias("blocks"), F.lit(1).cast("long").alias("met"))
        return best.withColumnRenamed("id", id_col), report
    wanted = materialize(wanted, "vector-queries")
    rows, balls = cells(items, n, block_rows)
    n_blocks = balls.count()
    groups = math.ceil(n_blocks / BLOCK_VECTORS)
    left = balls.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).withColumn("bucket", every(buckets))
    right = wanted.withColumn("bucket", bucket()).withColumn("part", every(groups))
    bounds = left.groupBy("bucket", "part").cogroup(right.groupBy("bucket", "part")).applyInPandas(bound, bounded)
    best, report = pruned_topk(bounds, meet, k, n / n_blocks)
    return best.withColumnRenamed("id", id_col), report


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, **columns) -> DataFrame:
    """``vector_search`` without the report."""
    return vector_search(vectors, queries, k, id_col, **columns)[0]
