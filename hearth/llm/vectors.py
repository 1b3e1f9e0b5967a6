"""Vectors as integer rows, for the operators that calculate exactly.

A component x becomes floor(256 * x). Rows whose vector is null or holds null
or non-finite components are dropped; so are vectors whose length is not the
common one (the most frequent length that the caller can use, ties to the
longer). The integers are kept as doubles, which hold them exactly, whatever
their size; inside a task they become int64 where ``exact_type`` proves that
nothing overflows, and Python integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import stored

SCALE = 256


def integer_vectors(df: DataFrame, key: str, label: str, vector: str, multiple_of: int = 1,
                    scale: int = SCALE) -> tuple[DataFrame, int]:
    """(row_id, key, label, q) of the rows that can be used, stored, and the length of ``q``.

    ``row_id`` tells rows apart, whatever their key. An empty table (or none that can be used) has length 0."""
    rows = df.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("bigint").alias("key"),
                     F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column("v")))
            if not b.num_rows:
                continue
            v = b.column("v")
            sizes = pc.list_value_length(v).to_numpy()
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(at[~np.isfinite(flat)], minlength=len(sizes)) == 0
            ends = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.floor(scale * flat[good[at]]), pa.float64()))
            kept = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("row_id", "key", "label")), whole], ["row_id", "key", "label", "q"])

    whole = stored(rows.mapInArrow(run, "row_id bigint, key bigint, label bigint, q array<double>"), "integer-vectors")
    size = F.size("q")
    common = whole.groupBy(size.alias("n")).count().filter(F.col("n") % multiple_of == 0).orderBy(F.desc("count"), F.desc("n")).first()
    n = common["n"] if common else 0
    return whole.filter(size == n), n


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """The rows of a list column of equal lengths, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)


def exact_type(bound: float) -> type:
    """int64 if ``bound``, the largest value that can come up, fits; else Python integers."""
    return np.int64 if bound < 2.0 ** 62 else object


def as_integers(a: np.ndarray, kind: type) -> np.ndarray:
    if kind is object:
        return np.array([int(x) for x in a.ravel()], dtype=object).reshape(a.shape)
    return a.astype(np.int64)


def longs(a: np.ndarray) -> np.ndarray:
    """Exact results as int64; values beyond raise, as an overflow does in Spark."""
    if a.dtype == object and any(not -2 ** 63 <= int(x) < 2 ** 63 for x in a.ravel()):
        raise OverflowError("a result does not fit a long")
    return a.astype(np.int64)
