"""Vectors in packed blocks: rows become Arrow-sized matrices that tasks multiply."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part: a non-null id, a vector that is not null or
    empty, without null or non-finite components, and with a component other than zero if nonzero."""
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.where(F.exists(v, lambda x: x != 0)) if nonzero else rows


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(n, -1) if n else np.zeros((0, 0)), dtype=dtype)


def by_length(table: pa.Table, vec_col: str = "v"):
    """Parts of a table whose vectors have the same length."""
    sizes = pc.list_value_length(table[vec_col]).to_numpy()
    for d in np.unique(sizes):
        yield int(d), table.filter(pa.array(sizes == d))


def pack(column: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(column, dtype=dtype).tobytes()


def merge_top(state: list[np.ndarray], score: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best of each row, highest score first and smaller id on ties, of a running (score, id) pair of
    [rows, k] arrays and new [rows, m] scores; absent places have id -1 and score -inf."""
    s = np.concatenate([state[0], score], axis=1)
    i = np.concatenate([state[1], np.broadcast_to(ids, score.shape)], axis=1)
    if s.shape[1] > 4 * k:  # keep what reaches the k-th score, ties included, before sorting
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        keep = s >= kth[:, None]
        width = int(keep.sum(axis=1).max())
        order = np.argsort(~keep, axis=1, kind="stable")[:, :width]
        s = np.where(np.take_along_axis(keep, order, axis=1), np.take_along_axis(s, order, axis=1), -np.inf)
        i = np.take_along_axis(i, order, axis=1)
    order = np.lexsort((np.where(s == -np.inf, np.iinfo(np.int64).max, i), -s), axis=1)[:, :k]
    return [np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)]
