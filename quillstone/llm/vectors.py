"""What the operators on vectors share: which rows take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are floor(SCALE * x).
SCALE = 256


def whole(vector: Column) -> Column:
    """The vector is there, is not empty and has neither a null nor a component that is not finite (a NaN is above all numbers)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def of_one_length(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vectors are as long as that of the least vec_id (nulls last, then the lesser vector), and that length (0: no rows)."""
    first = rows.select(F.col(vec_id), F.col(vector)).orderBy(F.col(vec_id).asc_nulls_last(), F.col(vector)).limit(1).collect()
    width = len(first[0][1]) if first else 0
    return rows.where(F.size(vector) == width), width


def limit(width: int) -> int:
    """Components beyond +-limit count as +-limit, so that no sum of products of a vector's components leaves 62 bits (2**27 at 64 components)."""
    return 1 << ((60 - max(width - 1, 1).bit_length()) // 2)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of whole vectors of one length, a row for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(limit(width))
    return np.clip(np.floor(flat * SCALE), -bound, bound).astype(np.int64).reshape(len(column), width)
