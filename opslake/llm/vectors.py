"""Integer vectors: checked, scaled and floored embeddings as compact binary values.

A vector takes part if it is not null, holds neither null nor non-finite
entries and has the table's usual length (the most frequent one, the larger of
equals).  ``x = floor(scale * c)`` is stored little-endian in the smallest of 1,
2, 4 or 8 bytes that holds the row's entries, so equal vectors are equal bytes
and a shuffled row of a unit vector takes 1 to 2 bytes a dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: entries are held within this bound, far beyond any embedding
BOUND = 1 << 62
_WIDTHS = (1, 2, 4, 8)


def usable(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> tuple[DataFrame, int, int]:
    """(rows that take part as (vec_id, v array of double), their dimension, their number); 0 without any."""
    v = F.col(vector).cast("array<double>")
    # NaN counts as larger than infinity, so one comparison finds both
    ok = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf")))))
    top = (ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    dim = top[0]["d"] if top else 0
    return ok.where(F.size("v") == dim), dim, top[0]["count"] if dim else 0


def floored(col: pa.Array, dim: int, scale: int) -> np.ndarray:
    """A column of double lists (all of length ``dim``) as a matrix of longs, floor(scale * c)."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * float(scale)), -float(BOUND), float(BOUND)).astype(np.int64).reshape(-1, dim)


def pack(x: np.ndarray) -> pa.Array:
    """Rows of a long matrix as binary values of the smallest width that holds each row."""
    if not len(x):
        return pa.array([], pa.binary())
    reach = np.maximum(x.max(axis=1), ~x.min(axis=1))  # ~v = -v - 1: the two's complement reach of a negative entry
    width = np.select([reach < 1 << 7, reach < 1 << 15, reach < 1 << 31], _WIDTHS[:3], 8)
    parts, order = [], []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        raw = np.ascontiguousarray(x[at].astype(f"<i{w}"))
        offsets = (np.arange(len(at) + 1) * x.shape[1] * w).astype(np.int64)
        parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        order.append(at)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order), kind="stable"))).cast(pa.binary())


def unpack(col: pa.Array, dim: int) -> np.ndarray:
    """The long matrix of a binary column made by ``pack``."""
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    width = np.diff(off) // max(dim, 1)
    out = np.empty((len(col), dim), np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        step = int(w) * dim
        if len(at) == len(col):
            out[:] = raw[off[0]:off[0] + len(at) * step].view(f"<i{w}").reshape(-1, dim)
        else:
            out[at] = raw[(off[at][:, None] + np.arange(step)).ravel()].view(f"<i{w}").reshape(-1, dim)
    return out


def packed(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x binary) of the rows that ``usable`` gave."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pack(floored(b.column(1), dim, scale))], ["vec_id", "x"])
    return rows.mapInArrow(run, "vec_id long, x binary")
