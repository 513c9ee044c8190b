"""Integer vectors: rows of an array column as whole numbers, and blocks of them in tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(col: str, size: int | None = None) -> Column:
    """Whether a vector is there and all its entries are finite (and it has `size` entries)."""
    finite = ~F.exists(col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    fits = F.lit(True) if size is None else F.size(col) == size
    return F.coalesce(F.col(col).isNotNull() & fits & finite, F.lit(False))


def integers(col: str, scale: int = 256) -> Column:
    """floor(scale * c) of every entry c, as double; beyond the range of long it is the nearest long."""
    return F.transform(col, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def vector_key(col: str) -> Column:
    """16 bytes that stand for an integer vector: equal vectors have equal keys."""
    return F.unhex(F.md5(F.array_join(F.col(col).cast("array<string>"), ",").cast("binary")))


def blocks(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of integers) for every length of vector in an Arrow list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return [(np.arange(len(sizes)), flat.reshape(len(sizes), int(sizes[0])))]
    ends = np.cumsum(sizes)
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((rows, flat[(ends[rows] - size)[:, None] + np.arange(size)]))
    return out


def largest(x: np.ndarray) -> int:
    """The greatest absolute value, as a Python integer."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x as it is where results up to `most` fit 64 bits, else as Python integers."""
    return x if most < 1 << 62 else x.astype(object)


def decimals(values) -> object:
    """An Arrow column decimal(38,0) of integers; null where one has more digits than that."""
    import decimal

    import pyarrow as pa

    kind = pa.decimal128(38, 0)
    if isinstance(values, np.ndarray) and values.dtype != object:
        return pa.array(values.astype(np.int64)).cast(kind)
    return pa.array([decimal.Decimal(int(v)) if abs(v) < 10**38 else None for v in values], kind)


def sums(df: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """Exact sums by key; null where one does not fit decimal(38,0)."""
    return df.groupBy(*keys).agg(*[F.try_sum(c).cast("decimal(38,0)").alias(c) for c in cols])
