"""What the operators on embeddings share: usable vectors as binary cells."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(embedding="embedding") -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    x = F.col(embedding)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, bad), F.lit(False))


def cells(vectors: DataFrame, embedding="embedding") -> DataFrame:
    """``vectors`` cut to vec_id and embedding as doubles, usable ones only."""
    return vectors.filter(F.col("vec_id").isNotNull() & usable(embedding)).select(
        "vec_id", F.col(embedding).cast("array<double>").alias("x"))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)
