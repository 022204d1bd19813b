"""Whole-number vectors for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are x with |x| below LARGEST, so that sums of products of whole numbers fit 64 bits; others count as not finite.
LARGEST = float(1 << 19)
SCALE = 256


def sound(vector: str) -> Column:
    """Whether a vector takes part: neither it nor a component is null, and all components are finite (and below LARGEST)."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < LARGEST)), F.lit(False))


def kept(df: DataFrame, id_col: str, vector: str, *more: Column) -> DataFrame:
    """(vec_id, vector, more) of the rows that take part; no other column of df matters."""
    return df.where(sound(vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("vector"), *more)


def whole(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component, [rows, width] of int32; shorter vectors are filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = np.asarray(vectors.offsets, np.int64)
    sizes = np.diff(ends)
    flat = np.floor(np.asarray(vectors.values, np.float64)[ends[0] : ends[-1]] * SCALE).astype(np.int32)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def packed(rows: np.ndarray) -> bytes:
    """Rows as bytes, two a number where all fit."""
    small = not len(rows) or (rows.min() >= -(1 << 15) and rows.max() < 1 << 15)
    return (b"s" if small else b"w") + rows.astype(np.int16 if small else np.int32).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if data[:1] == b"s" else np.int32, offset=1).reshape(count, -1)
