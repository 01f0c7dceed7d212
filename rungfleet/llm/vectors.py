"""Integer vectors of an embedding table, and how they reach numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a component is multiplied by before it is rounded down.
SCALE = 1024


def integer_vectors(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """``df`` with ``y``, the vector as longs ``floor(1024 * component)``, in place of
    ``vector``, and the number of components.

    Rows go whose vector is null or holds null, NaN or infinite entries; so do
    rows of another length than most of those that are left (the longer one of
    two that are as frequent), and empty vectors. Values beyond a long become the
    largest or smallest long. Without rows the number is 0.
    """
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(whole)
    lengths = kept.groupBy(F.size(vector).alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    dims = lengths["k"] if lengths else 0
    y = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return kept.where(F.size(vector) == dims).withColumn(vector, y).withColumnRenamed(vector, "y"), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column whose lists have ``dims`` entries each, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
