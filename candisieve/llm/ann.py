"""Approximate nearest neighbours by stable projections.

Unit vectors are projected on a few Gaussian directions, and every block of rows is indexed by a
kd-tree over the projections. A query takes its projected neighbours leaf by leaf, nearest first, and
verifies them on the original vectors. The squared projected distance over the squared true one
follows a chi-square law, which bounds the chance that a nearer row is still unseen; the search
stops when that chance is small enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 16
LEAF_ROWS = 32
BLOCK_ROWS = 4096
QUERY_ROWS = 512
CONFIDENCE = 0.985
SEED = 11


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    half = np.minimum(np.maximum(x, 0.0) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / factorial(i) for i in range(degrees // 2))


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by a power of two, which changes no digit, so that no square over- or underflows; and their norms."""
    _, power = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    even = np.ldexp(vectors, -power)
    return even, np.sqrt(np.add.reduce(even * even, axis=-1))


def cosines(rows: np.ndarray, norms: np.ndarray, vector: np.ndarray, norm: float) -> np.ndarray:
    """One sum in a fixed order for each pair, so equal vectors get equal scores wherever they lie."""
    return np.add.reduce(rows * vector, axis=1) / (norms * norm)


class ProjectedTree:
    """A kd-tree over the projections of a block of unit vectors, kept as its leaves' rows and boxes."""

    def __init__(self, ids: np.ndarray, original: np.ndarray, directions: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.ids = ids
        self.even, self.norms = scaled(original)
        self.directions = directions
        points = (self.even / self.norms[:, None]) @ directions
        self.leaves: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            rows = waiting.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order = np.argpartition(own[:, axis], len(rows) // 2)
            waiting += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.low = np.array([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in self.leaves])
        self.starts = np.cumsum([0] + [len(rows) for rows in self.leaves])
        self.rows = np.concatenate(self.leaves)

    def search(self, own_id: int, vector: np.ndarray, k: int, confidence: float) -> tuple[np.ndarray, np.ndarray]:
        """The ids and cosines of up to ``k`` neighbours, nearest first, ties to the smaller id.

        Leaves come in the order of their boxes' distance from the query. Before each group of
        leaves the test asks how likely a row nearer than the k-th verified one would have shown by
        now; above ``confidence`` the rest stays unseen.
        """
        even, norm = scaled(vector)
        at = (even / norm) @ self.directions
        gap = np.maximum(np.maximum(self.low - at, at - self.high), 0)
        reach = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(reach, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        step, done = max(1, -(-4 * k // LEAF_ROWS)), 0
        degrees = self.directions.shape[1]
        while done < len(order):
            if len(ids) == k:
                # Squared distance of unit vectors from their cosine; never below rounding.
                true = max(2 - 2 * scores[-1], 1e-12)
                if chi_square(reach[order[done]] / true, degrees) >= confidence:
                    break
            taken = order[done: done + step]
            done += step
            rows = np.concatenate([self.leaves[i] for i in taken])
            rows = rows[self.ids[rows] != own_id]
            near = cosines(self.even[rows], self.norms[rows], even, float(norm))
            ids = np.concatenate([ids, self.ids[rows]])
            scores = np.concatenate([scores, near])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            step = min(64, step * 2)
        return ids, scores


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not the zero vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    projections: int = PROJECTIONS, confidence: float = CONFIDENCE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found rows of every query by cosine.

    Vectors that are null, zero or hold a null or non-finite component take no part. A vector of
    another length than a query's is no candidate of that query. Fewer than ``k`` candidates are all
    returned. Rows that repeat an id are one candidate each and all count as the query's own; a
    repeated query is searched once. An empty table gives no rows.

    Rows are dealt into blocks of about ``BLOCK_ROWS`` and queries into blocks of about
    ``QUERY_ROWS``; each pair of blocks is one group, so a task holds one tree and one block of
    queries at a time. Each pair of blocks keeps ``k`` per query, and a window of ``k`` times the
    number of row blocks picks the final ones.
    """
    named = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
                        is_query.alias("q")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    n = named.count()
    row_blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-named.where("q").count() // QUERY_ROWS))
    spread = lambda column, parts, salt: F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    stored = named.select(spread("vec_id", row_blocks, 1).alias("row_block"), every(query_blocks).alias("query_block"),
                          "vec_id", "v", F.lit(False).alias("q"))
    asked = named.where("q").dropDuplicates(["vec_id"]).select(
        every(row_blocks).alias("row_block"), spread("vec_id", query_blocks, 2).alias("query_block"), "vec_id", "v", F.lit(True).alias("q"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        lengths = group["v"].map(len)
        for length in lengths[group["q"]].unique():
            part = group[lengths == length]
            held = part[~part["q"]].sort_values("vec_id")
            if not len(held):
                continue
            directions = np.random.RandomState(SEED).standard_normal((length, projections))
            tree = ProjectedTree(held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()), directions)
            for own, v in part.loc[part["q"], ["vec_id", "v"]].itertuples(index=False):
                ids, scores = tree.search(own, np.asarray(v), k, confidence)
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = stored.unionByName(asked).groupBy("row_block", "query_block").applyInPandas(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
