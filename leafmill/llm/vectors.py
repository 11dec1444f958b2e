"""Helpers of the vector operators: sound rows, integer matrices and their binary columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def is_sound(vector: str | Column) -> Column:
    """True for a vector that is not NULL and holds neither NULLs nor components that are not finite."""
    values = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    return F.coalesce(values.isNotNull() & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def usual_length(rows: DataFrame, vector: str, step: int = 1) -> int:
    """The length that most vectors have, of those that ``step`` divides; the longer one of a tie, 0 without any."""
    size = F.size(vector)
    top = (rows.filter((size > 0) & (size % step == 0)).groupBy(size.alias("size")).count()
           .agg(F.max(F.struct("count", "size")).alias("top")).first()["top"])
    return top["size"] if top else 0


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """Array column of ``width`` numbers each, none NULL, as a matrix of doubles."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, width)


def whole_numbers(values: np.ndarray, scale: int, width: int) -> np.ndarray:
    """floor(scale * value) as integers, refused where sums of ``width`` products could leave 64 bits."""
    found = np.floor(values * scale)
    most = 2 ** 30 // int(np.ceil(np.sqrt(max(width, 1))))
    if found.size and np.abs(found).max() >= most:
        raise ValueError(f"a component times {scale} must stay below {most}")
    return found.astype(np.int32)


def as_binary(values: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    values = np.ascontiguousarray(values)
    step = values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = np.arange(len(values) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)]).cast(pa.binary())


def from_binary(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The matrix of a binary column whose values are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of matrices: in doubles while every sum stays below 2^53, else in integers."""
    width = left.shape[-1]
    if left.size and right.size and width * int(np.abs(left).max()) * int(np.abs(right).max()) < 2 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64)).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64)


def batches_of(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One record batch from each tuple of arrays."""
    for arrays in rows:
        yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)
