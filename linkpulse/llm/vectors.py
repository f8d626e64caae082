"""What the operators on vectors share: which rows take part, whole numbers of components, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this size have no exact 64-bit results here.
LARGEST = 2.0**13


def usable(column: str) -> Column:
    """Whether a vector is there and all its components are finite numbers; an empty vector is none."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(finite, F.lit(False))


def floored(column: str, scale: int) -> Column:
    """floor(scale * x) of every component, from its double value."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def bounds(vectors: DataFrame, column: str) -> tuple[int, int]:
    """How many vectors there are, and the length of the longest; an error where components are beyond LARGEST."""
    size = F.aggregate(column, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, width, most = vectors.agg(F.count("*"), F.max(F.size(column)), F.max(size)).first()
    if n and most > LARGEST:
        raise ValueError(f"a component of size {most}; results are exact up to {LARGEST:.0f} only")
    return n, width or 0


def matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Rows of an Arrow list column; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):  # a chunked array without or with many chunks
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    at = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(kind)
    sizes = np.diff(at)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), kind)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows).reshape(-1)))
