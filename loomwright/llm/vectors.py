"""Vectors as fixed-length bytes, and tasks that walk through sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is set, not zero, without NULL or non-finite components and of the most frequent length."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = df.filter(F.coalesce(fine, F.lit(False)))
    length = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size(v) == (length["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without NULLs as rows of float64."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def stored_kind(df: DataFrame, vector: str) -> str:
    """How many bytes hold a component without loss."""
    return "<f4" if df.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def packed(rows: np.ndarray, kind: str = "<f8") -> pa.Array:
    data = np.ascontiguousarray(rows, kind)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1] * data.itemsize), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def row_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; each depends on its own two rows only."""
    return (a * b).sum(axis=1)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1024) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of sorted batches that lie within one group, of at most ``most`` rows; True where a group begins."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = np.column_stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        edges = np.concatenate([[0], np.flatnonzero((data[1:] != data[:-1]).any(axis=1)) + 1, [len(data)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            key = tuple(data[i])
            for at in range(i, j, most):
                yield at == i and key != last, batch.slice(at, min(most, j - at))
            last = key
