"""Regular time grids per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.series import micros

_BLOCK = 4096


def grid_between(spans: DataFrame, keys: Sequence[str], start: str, end: str, step: str, out: str) -> DataFrame:
    """Grid points start, start + step, ... <= end for each row of ``spans``.

    A long span is cut into blocks first, and the blocks are spread over the tasks, so
    neither one array nor one task holds a whole grid.
    """
    us = micros(step)
    lo, hi = F.unix_micros(start), F.unix_micros(end)
    blocks = spans.select(
        *keys,
        lo.alias("_lo"),
        hi.alias("_hi"),
        F.explode(F.sequence(lo, hi, F.lit(us * _BLOCK))).alias("_b"),
    ).repartition(*keys, "_b")
    last = F.least(F.col("_hi"), F.col("_b") + us * (_BLOCK - 1))
    points = F.explode(F.sequence(F.col("_b"), last, F.lit(us)))
    return blocks.select(*keys, points.alias("_p")).select(*keys, F.timestamp_micros("_p").alias(out))


def fill_grid(df: DataFrame, keys: Sequence[str], bucket: str, step: str) -> DataFrame:
    """Add the missing buckets between the first and the last one of each key."""
    spans = df.groupBy(*keys).agg(F.min(bucket).alias("_from"), F.max(bucket).alias("_to"))
    grid = grid_between(spans, keys, "_from", "_to", step, bucket)
    return grid.join(df, [*keys, bucket], "left")
