"""Usable embedding vectors, shared by the two embedding operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def numbered(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double)."""
    return df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists as a 2-d array."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)
