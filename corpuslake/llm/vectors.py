"""Integer vectors, made in the JVM, and exact products of blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import semi_by_size, without, written

#: Components beyond this don't fit: squared distances and products of longer vectors would pass a long.
LARGEST = 1 << 27
#: Components up to this have products and distances that a double holds exactly.
_EXACT = 1 << 20


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def usable(vector: Column, scale: int = 256) -> Column:
    """Whether the vector is there, no component is null, NaN or infinite and none scales beyond ``LARGEST``."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= LARGEST / scale)
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def one_vector_each(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """Of rows that repeat a key, the one with the smallest other columns; of the rest only the keys are dealt out."""
    again = rows.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col(key).alias("__again"))
    again = written(again, "again")
    if again.isEmpty():
        return rows
    others = [c for c in rows.columns if c != key]
    own = semi_by_size(rows, again.withColumnRenamed("__again", key), [key])
    least = own.groupBy(key).agg(F.min(F.struct(*others)).alias("least")).select(key, *(F.col(f"least.{c}") for c in others))
    return without(rows, again, rows[key] == again["__again"]).unionByName(least.select(rows.columns))


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """(rows, dims) longs of a list column; shorter vectors end in zeros, which adds nothing to a product."""
    lens = np.asarray(column.value_lengths(), np.int64)
    dims = int(lens.max(initial=0)) if dims is None else dims
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lens == dims).all():
        return flat.reshape(len(lens), dims)
    out = np.zeros((len(lens), dims), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b`` (over the components that both have)."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= _EXACT and d <= 4096:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    return (a * a).sum(axis=1)[:, None] - 2 * products(a, b) + (b * b).sum(axis=1)[None, :]
