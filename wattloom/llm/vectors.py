"""Integer vectors: scaled entries, Arrow lists as matrices, exact sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# beyond this an entry is no longer exact as a double; larger ones are held here
LARGEST = float(1 << 53)
DECIMAL = pa.decimal128(38, 0)


def finite(vector: str) -> Column:
    """True where the vector has entries and none of them is null, NaN or infinite."""
    inf = F.lit(float("inf"))
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == inf))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def scaled(vector: str, scale: float, shift: int = 0) -> Column:
    """``floor(scale * c) + shift`` of each entry, as longs; products beyond 2^53 are held there."""

    def whole(c: Column) -> Column:
        held = F.greatest(F.least(c.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(held).cast("long") + F.lit(shift).cast("long")

    return F.transform(vector, whole)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of ``width`` longs as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def exact(values: np.ndarray, times: int) -> np.ndarray:
    """The integers as they are if their products with ``times`` fit into 64 bits, else as Python integers."""
    top = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
    return values if top * times < 1 << 62 else values.astype(object)


def decimals(values: np.ndarray) -> pa.Array:
    """Integers of 64 bits or of Python as decimals."""
    if values.dtype == object:
        return pa.array([int(v) for v in values], DECIMAL)
    return pa.array(values.astype(np.int64)).cast(DECIMAL)


def sums(df: DataFrame, vector: str, width: int, group: str | None = None) -> DataFrame:
    """(g, n, sums): rows and exact sums of the entries per group, or over all (g is 0); sums are decimals.

    Each task adds up what it reads, so the shuffle carries one row a task and group. ``group`` is a column of small
    integers.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x = matrix(batch.column("x"), width)
            x = exact(x, max(1, len(x)))
            groups = batch.column("g").to_numpy()
            for g in np.unique(groups):
                mine = x[groups == g]
                n, so_far = total.get(int(g), (0, np.zeros(width, dtype=object)))
                total[int(g)] = [n + len(mine), so_far + mine.sum(axis=0).astype(object)]
        keys = list(total)
        listed = pa.array([[int(v) for v in total[g][1]] for g in keys], pa.list_(DECIMAL))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total[g][0] for g in keys], pa.int64()), listed], ["g", "n", "sums"])

    number = F.col(group).cast("long") if group else F.lit(0).cast("long")
    parts = df.select(number.alias("g"), F.col(vector).alias("x")).mapInArrow(add, "g long, n long, sums array<decimal(38,0)>")
    each = parts.select("g", "n", F.posexplode("sums").alias("i", "s"))
    each = each.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"])
    return each.groupBy("g").agg(F.max("n").alias("n"), listed.alias("sums"))
