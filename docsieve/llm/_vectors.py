"""Vectors as rows: which take part, equal ones as one, and packs of them as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import stored


def finite(vec: str) -> Column:
    """True for a vector that is not null and holds no null or non-finite component."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, ok), F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(cls, *by, vec, ids) of rows with ``id``, ``vec`` and ``by``, stored: equal vectors are one row with their ``keep`` smallest ids.

    Of a much repeated vector, every task passes on the rows of its smallest ids only.
    Rows that repeat an id with the same vector count once.
    """
    key = [*by, "ha", "hb"]
    marked = rows.select("id", *by, "vec", F.xxhash64("vec").alias("ha"), F.xxhash64(F.lit(3), "vec").alias("hb"))
    first = marked.withColumn("place", F.dense_rank().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("place") <= keep)
    one = first.groupBy(*key).agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids"))
    return stored(one.select(*by, "vec", "ids").withColumn("cls", F.monotonically_increasing_id()))


def lengths(classes: DataFrame) -> list[int]:
    """The lengths of vectors that occur; each is a space of its own."""
    return sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect())


def matrix(x: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as rows."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), dim)


def binary(a: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.arange(len(a) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(a.tobytes())])


def rows_of(cells: list[bytes], dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), dim)


def best(rows: DataFrame, of: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; tasks pass on no more than these."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order))).where(F.col("rank") <= k)
