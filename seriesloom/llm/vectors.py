"""Whole-number vectors shared by the vector operators."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True where a vector is present and all its components are present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vector: str, scale: int, limit: int) -> Column:
    """floor(scale * component), kept within -limit .. limit so that sums of products fit 64 bits."""
    def one(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(float(-limit))), F.lit(float(limit)))).cast("int")

    return F.transform(vector, one)


def component_limit(dims: int, bits: int = 62) -> int:
    """The largest component for which a squared distance of `dims` components stays within 2^bits, an inner product within a quarter."""
    return max(isqrt(2**bits // max(dims, 1)) // 2, 1)


def dense(lists: pa.Array) -> np.ndarray:
    """Rows of a list column as one 64-bit matrix; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]].astype(np.int64)
    if len(size) == 0 or (size == size[0]).all():
        return flat.reshape(len(size), size[0] if len(size) else 0)
    out = np.zeros((len(size), size.max()), np.int64)
    out[np.arange(size.max()) < size[:, None]] = flat
    return out


def longest(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(vector))).first()[0] or 0
