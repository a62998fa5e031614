"""Vectors of floats as vectors of whole numbers, floor(256 c) of each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256


def whole_vectors(df: DataFrame, vector_col: str, keep: dict[str, str]) -> DataFrame:
    """Rows whose vector and components are all there and finite: the columns of ``keep`` (name to source column) and x, an array of long.

    Components beyond the range of a long are its limits.
    """
    c = F.col(vector_col).cast("array<double>")
    out = df.select(*[F.col(source).alias(name) for name, source in keep.items()], c.alias("c")).where("c IS NOT NULL")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out.where(F.forall("c", finite)).select(*keep, F.transform("c", lambda v: F.floor(F.lit(float(SCALE)) * v)).alias("x"))


def padded(df: DataFrame, d: int) -> DataFrame:
    """``df`` with every x of length d: components that a shorter vector lacks are zero."""
    return df.withColumn("x", F.when(F.size("x") < d, F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x")))).otherwise(F.col("x")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an array column whose lists all have d entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)
