"""Vector expressions and embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candisieve.functions.text import let

# Scores are rounded here before ranking, so the order of a sum cannot reorder ties.
SCORE_DIGITS = 9


def as_vector(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(c: Column) -> Column:
    """Scale to length one; the zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x))
    return let(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(x)))


def max_similarity(vectors: Column, query: Column) -> Column:
    """Best inner product over several vectors of a row; none gives null."""
    return F.array_max(F.transform(vectors, lambda v: dot(v, query)))


def embed(
    df: DataFrame, text_col: str, load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    out_col: str = "embedding",
) -> DataFrame:
    """Add the embedding of a text column.

    ``load_model`` runs once per task and returns a function from a list of texts to a
    matrix; batches arrive through Arrow. The model is the caller's.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            matrix = np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)
            yield pd.Series(list(matrix), index=texts.index)

    return df.withColumn(out_col, encode(F.col(text_col)))
