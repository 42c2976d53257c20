"""Selecting, resampling and aligning raw readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import coerce_numeric
from wattloom.operators.grids import fill_grid
from wattloom.series import Series

# fixed values: measurements in the order they are tried
MEASUREMENTS = ("W", "°C", "kW", "kWh", "%", "state", " ")


def dedup(df: DataFrame, s: Series) -> DataFrame:
    """One reading per (key, ts): the mean of the readings that share it."""
    return df.groupBy(*s.keys, s.ts).agg(F.avg(s.value).alias(s.value))


def scan_entity_range(df: DataFrame, entity: str, start, end, s: Series = Series()) -> DataFrame:
    """Raw rows of one entity, both ends included."""
    return df.filter((F.col(s.keys[-1]) == entity) & F.col(s.ts).between(F.lit(start), F.lit(end)))


def resample_mean(df: DataFrame, s: Series, bucket: str = "5 minutes", out: str = "bucket") -> DataFrame:
    """Mean per epoch-aligned bucket, labelled by its start; buckets without rows are absent."""
    start = F.window(s.ts, bucket).start.alias(out)
    return df.groupBy(*s.keys, start).agg(F.avg(s.value).alias(s.value))


def resample_mean_nullfill(df: DataFrame, s: Series, bucket: str = "1 minute", out: str = "bucket") -> DataFrame:
    """As ``resample_mean``, with NULL rows for the empty buckets in between."""
    return fill_grid(resample_mean(df, s, bucket, out), s.keys, out, bucket)


def measurement_autodetect(df: DataFrame, entity: str = "entity_id", measurement: str = "measurement", order: Sequence[str] = MEASUREMENTS) -> DataFrame:
    """Keep, per entity, the rows of the first measurement in ``order`` that has any."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(measurement))
    known = df.filter(F.col(measurement).isin(*order))
    chosen = known.groupBy(entity).agg(F.min_by(measurement, rank).alias(measurement))
    return known.join(chosen, [entity, measurement], "left_semi")


def list_entities(df: DataFrame, contains: str | None = None, entity: str = "entity_id") -> DataFrame:
    ids = df.select(entity).distinct()
    if contains:
        ids = ids.filter(F.lower(entity).contains(contains.lower()))
    return ids.orderBy(entity)


def list_measurements(df: DataFrame, keywords: Sequence[str] = (), measurement: str = "measurement") -> DataFrame:
    names = df.select(measurement).distinct()
    if keywords:
        names = names.filter(F.lower(measurement).rlike("|".join(keywords)))
    return names.orderBy(measurement)


def list_fields(df: DataFrame, of: str, measurement: str = "measurement", field: str = "field") -> DataFrame:
    return df.filter(F.col(measurement) == of).select(field).distinct().orderBy(field)


def query_range_pivot(df: DataFrame, measurement: str, fields: Sequence[str], start, stop, s: Series = Series(), entity: str | None = None) -> DataFrame:
    """Fields of one measurement as columns per time; start included, stop excluded."""
    rows = df.filter(
        (F.col("measurement") == measurement)
        & F.col("field").isin(*fields)
        & (F.col(s.ts) >= F.lit(start))
        & (F.col(s.ts) < F.lit(stop))
    )
    if entity is not None:
        rows = rows.filter(F.col(s.keys[-1]) == entity)
    return rows.groupBy(*s.keys, s.ts).pivot("field", list(fields)).agg(F.first(s.value))


def align_entities(df: DataFrame, entities: Sequence[str], s: Series, bucket: str = "5 minutes", entity: str = "entity_id", within: Sequence[str] = ()) -> DataFrame:
    """Resampled entities side by side, one row per bucket that has any of them.

    One grouping by bucket; the entity is chosen inside the aggregate.
    """
    start = F.window(s.ts, bucket).start.alias("bucket")
    means = [F.avg(F.when(F.col(entity) == e, F.col(s.value))).alias(str(e)) for e in entities]
    return df.filter(F.col(entity).isin(*entities)).groupBy(*within, start).agg(*means)


def numeric_readings(df: DataFrame, col: str, drop: bool = False) -> DataFrame:
    """Text to number; what is not a number becomes NULL, or is dropped."""
    out = df.withColumn(col, coerce_numeric(col))
    return out.filter(F.col(col).isNotNull()) if drop else out


def tail_period(df: DataFrame, s: Series, period: str = "24 hours", inclusive: bool = False) -> DataFrame:
    """Rows of the last ``period`` before the newest row of each series."""
    newest = df.groupBy(*s.keys).agg((F.max(s.ts) - F.expr(f"INTERVAL {period}")).alias("_from"))
    after = F.col(s.ts) >= F.col("_from") if inclusive else F.col(s.ts) > F.col("_from")
    return df.join(newest, list(s.keys)).filter(after).drop("_from")


def read_state_history(df: DataFrame, s: Series, state: str = "state", days: int = 7) -> DataFrame:
    """Numeric states of the last days of each entity."""
    recent = tail_period(df, s, f"{days} days", inclusive=True)
    return numeric_readings(recent.withColumn(s.value, F.col(state)), s.value, drop=True).drop(state)


def distinct_union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def available_features(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that hold any value, from one aggregation."""
    present = [c for c in cols if c in df.columns]
    seen: list[Column] = [F.count(c).alias(c) for c in present]
    counts = df.agg(*seen).first()
    return [c for c in present if counts[c]]
