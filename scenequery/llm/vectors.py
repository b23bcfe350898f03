"""What the operators on embeddings share: vectors as whole numbers, packed into bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Widths of signed whole numbers that a vector may be packed in.
WIDTHS = (1, 2, 4, 8)


def usable(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is not null and holds neither nulls nor values that are not finite."""
    whole = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col(column).isNotNull() & F.coalesce(whole, F.lit(False)))


def longest(rows: DataFrame, column: str) -> int:
    """The number of entries of the longest vector; 0 without any."""
    return rows.agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("n")).collect()[0]["n"]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    found = np.zeros((len(column), dims))
    found[np.arange(dims) < sizes[:, None]] = flat
    return found


def floored(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as whole numbers of 64 bits."""
    x = np.floor(values * scale)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise ValueError(f"a component is too large: {scale} times it must stay below 2 to the power 62")
    return x.astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest width that holds it, which its last byte names: equal rows give equal bytes."""
    found: list[bytes] = [b""] * len(x)
    size = np.maximum(x.max(1, initial=0), -(x.min(1, initial=0) + 1))
    width = np.searchsorted([1 << 7, 1 << 15, 1 << 31], size, side="right")
    for w in np.unique(width).tolist():
        rows, end = np.flatnonzero(width == w), bytes([WIDTHS[w]])
        for i, row in zip(rows.tolist(), x[rows].astype(f"<i{WIDTHS[w]}"), strict=True):
            found[i] = row.tobytes() + end
    return found


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    found = np.zeros((len(rows), dims), np.int64)
    widths = np.array([r[-1] for r in rows], np.int64)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        found[own] = np.frombuffer(b"".join(rows[i][:-1] for i in own.tolist()), f"<i{w}").reshape(len(own), dims)
    return found
