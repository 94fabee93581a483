"""Hash embedding of text and vector arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def hash_vector(text: str | None, dimensions: int = 1024) -> np.ndarray:
    """Unit vector of character counts per bucket ``code point * position mod d``."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    counts = np.bincount(points * np.arange(1, len(points) + 1) % dimensions, minlength=dimensions).astype(float)
    return counts / (np.sqrt((counts * counts).sum()) or 1.0)


def hash_embedding(text: Column, dimensions: int = 1024) -> Column:
    """``hash_vector`` of a column, as one Arrow-batched map.

    Exploding every character instead would shuffle one row per character.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pd.Series) -> pd.Series:
        return batch.map(lambda value: hash_vector(value, dimensions))

    return embed(text)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing, empty or zero vector and for unequal lengths."""
    length = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (length > 0)
    return F.when(usable, dot(a, b) / length).otherwise(F.lit(0.0))
