"""Series description and windows over time slices.

One sensor may hold a large share of all rows, so no window here is partitioned by the
series key alone.  Every series is cut into time slices and windows run per
``(key, slice)``.  ``fitted`` cuts each series where its rows are: slices of about equal
row counts, at cell borders that a row finds by arithmetic and one array access; without
it slices have a constant length.  What a row needs from outside its slice is brought in by one of

* ``with_neighbours`` - the last / first n rows around the slice (row frames, lag, lead),
* ``with_time``       - rows within a time distance of the slice (range frames),
* ``running``         - a per-slice summary, carried over the slices of a key (unbounded
  frames: last value, running sum).

Only the summaries - one row per slice - are ever windowed by the key alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattloom.session import saved

SLICE = "_slice"
ORD = "_ord"
HOME = "_home"

_UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def micros(duration: str) -> int:
    """Microseconds of a duration such as ``"10 minutes"``."""
    amount, unit = duration.split()
    return round(float(amount) * _UNIT_MICROS[unit.rstrip("s")])


@dataclass(frozen=True)
class Series:
    """Names of the key, time and value columns, and how series are cut into time slices.

    ``cuts`` is the table that ``fitted`` makes, by the columns ``cut_keys``; a series that it does not know, and every
    one without it, has slices of the constant length ``slice``. ``(keys, ts)`` is unique: readings are deduplicated
    at ingest.
    """

    keys: tuple[str, ...] = ("entity_id",)
    ts: str = "ts"
    value: str = "value"
    slice: str = "7 days"
    cuts: DataFrame | None = field(default=None, compare=False, repr=False)
    cut_keys: tuple[str, ...] = ()

    def of(self, value: str) -> Series:
        return replace(self, value=value)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, SLICE).orderBy(ORD)

    @property
    def slices(self) -> WindowSpec:
        """Window over the slice summaries of a key."""
        return Window.partitionBy(*self.keys).orderBy(SLICE)


def sized(df: DataFrame, s: Series, target_rows: int = 2_000_000) -> Series:
    """Pick the longest slice that keeps the densest slice within ``target_rows``.

    Runs one aggregation over hours; a slice never gets shorter than a second.
    """
    hour = F.date_trunc("hour", s.ts)
    peak = df.groupBy(*s.keys, hour.alias("_h")).count().agg(F.max("count")).first()[0] or 1
    seconds = max(1, min(3600 * target_rows // peak, 366 * 86_400))
    return replace(s, slice=f"{seconds} seconds")


#: rows a slice is cut for
TARGET_ROWS = 1_000_000
#: cells of a series at most, which is the length of the array a row looks its slice up in
MAX_CELLS = 1 << 20
_KEY, _FROM, _CELL, _IDS = "_cut_key", "_cut_from", "_cut_cell", "_cut_ids"


def _cut_key(names: Sequence[str]) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x02")) for k in names])


def fitted(df: DataFrame, s: Series, frame: str = "2 hours", target_rows: int | None = None) -> Series:
    """The series description with slices cut for about ``target_rows`` rows each, from the rows of ``df``.

    Time is divided into cells per series: at least as long as ``frame`` (the widest time frame used, so that a row
    is copied to two slices at most where slices are a cell long), else so short that the densest hour has two cells
    for every ``target_rows`` rows. Consecutive cells are joined until they hold that many. One pass counts rows by
    hour, one by cell; the table has one row a series and is saved for all queries over it.
    """
    target = target_rows or TARGET_ROWS
    hour = micros("1 hour")
    rows = df.select(_cut_key(s.keys).alias(_KEY), F.unix_micros(s.ts).alias("_t")).filter("_t IS NOT NULL")
    hours = rows.groupBy(_KEY, F.expr(f"_t div {hour}").alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    spans = hours.groupBy(_KEY).agg(F.max("_n").alias("_peak"), F.min("_lo").alias(_FROM), F.max("_hi").alias("_hi"))
    span = F.col("_hi") - F.col(_FROM)
    dense = F.floor(F.lit(hour * target / 2) / F.col("_peak"))
    cell = F.greatest(F.lit(micros(frame)), dense, F.floor(span / F.lit(MAX_CELLS)) + 1).cast("long")
    spans = spans.withColumn(_CELL, cell).withColumn("_size", (F.expr(f"(_hi - {_FROM}) div {_CELL}") + 1).cast("int"))
    spans = saved(spans.select(_KEY, _FROM, _CELL, "_size"), "spans")
    counts = rows.join(spans, _KEY).groupBy(_KEY, F.expr(f"cast((_t - {_FROM}) div {_CELL} AS int)").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    cells = spans.select(_KEY, F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_c")).join(counts, [_KEY, "_c"], "left")
    # cells are counts: at most MAX_CELLS a series
    order = Window.partitionBy(_KEY).orderBy("_c")
    n = F.coalesce("_n", F.lit(0))
    cells = cells.withColumn("_before", F.floor((F.sum(n).over(order) - n) / target))
    cells = cells.withColumn("_id", F.dense_rank().over(Window.partitionBy(_KEY).orderBy("_before")) - 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_c", "_id"))), lambda c: c["_id"])
    table = cells.groupBy(_KEY).agg(ids.alias(_IDS)).join(spans.drop("_size"), _KEY)
    return replace(s, cuts=saved(table, "cuts"), cut_keys=s.keys)


def constant(s: Series, slice: str) -> Series:
    """The same series in slices of a constant length, which are the same for all series."""
    return replace(s, slice=slice, cuts=None, cut_keys=())


def _is_cut(df: DataFrame, s: Series) -> bool:
    return s.cuts is not None and all(k in df.columns for k in s.cut_keys)


def with_cuts(df: DataFrame, s: Series) -> DataFrame:
    """The cuts of each row's series: a row a series, joined by adaptive execution as their size asks."""
    if not _is_cut(df, s) or _IDS in df.columns:
        return df
    return df.withColumn(_KEY, _cut_key(s.cut_keys)).join(s.cuts, _KEY, "left")


def slice_of(df: DataFrame, s: Series, micros_sql: str) -> Column:
    """Slice of a moment given as SQL; ``df`` has its cuts."""
    plain_slice = f"({micros_sql}) div {micros(s.slice)}"
    if _IDS not in df.columns:
        return F.expr(plain_slice)
    at = f"least(greatest((({micros_sql}) - {_FROM}) div {_CELL}, 0), size({_IDS}) - 1)"
    return F.expr(f"CASE WHEN {_IDS} IS NULL THEN {plain_slice} ELSE cast({_IDS}[cast({at} AS int)] AS long) END")


def without_cuts(df: DataFrame) -> DataFrame:
    return df.drop(_KEY, _FROM, _CELL, _IDS)


def sliced(df: DataFrame, s: Series) -> DataFrame:
    """Add the order column (microseconds) and the slice number."""
    if SLICE in df.columns:
        return df
    cut = with_cuts(df.withColumn(ORD, F.unix_micros(s.ts)), s)
    return without_cuts(cut.withColumn(SLICE, slice_of(cut, s, ORD)))


def plain(df: DataFrame) -> DataFrame:
    """Drop rows that belong to another slice, and the helper columns."""
    if HOME in df.columns:
        df = df.filter(HOME)
    return df.drop(SLICE, ORD, HOME)


def home(df: DataFrame) -> DataFrame:
    """Drop rows that belong to another slice; keep the slice for the next step."""
    return df.filter(HOME).drop(HOME)


def _edge_rows(base: DataFrame, s: Series, n: int, before: bool) -> DataFrame:
    order = F.col(ORD).desc() if before else F.col(ORD).asc()
    nearest = Window.partitionBy(*s.keys, SLICE).orderBy(order)
    rest = [c for c in base.columns if c not in (*s.keys, SLICE, ORD)]
    packed = (
        base.withColumn("_r", F.row_number().over(nearest))
        .filter(F.col("_r") <= n)
        .groupBy(*s.keys, SLICE)
        .agg(F.sort_array(F.collect_list(F.struct(ORD, *rest))).alias("_rows"))
    )
    frame = s.slices.rowsBetween(-n, -1) if before else s.slices.rowsBetween(1, n)
    packed = packed.withColumn("_rows", F.flatten(F.collect_list("_rows").over(frame)))
    start = F.greatest(F.size("_rows") - n, F.lit(0)) + 1 if before else F.lit(1)
    taken = packed.select(*s.keys, SLICE, F.explode(F.slice("_rows", start, F.lit(n))).alias("_x"))
    return taken.select(*s.keys, SLICE, "_x.*").withColumn(HOME, F.lit(False))


def with_neighbours(df: DataFrame, s: Series, back: int = 0, ahead: int = 0) -> DataFrame:
    """Give every slice the ``back`` rows before it and the ``ahead`` rows after it."""
    base = sliced(df, s)
    parts = [base.withColumn(HOME, F.lit(True))]
    if back:
        parts.append(_edge_rows(base, s, back, before=True))
    if ahead:
        parts.append(_edge_rows(base, s, ahead, before=False))
    return reduce(DataFrame.unionByName, parts)


def with_time(df: DataFrame, s: Series, back: str | None = None, ahead: str | None = None) -> DataFrame:
    """Give every slice the rows up to ``back`` before it and ``ahead`` after it."""
    after = micros(back) if back else 0
    before = micros(ahead) if ahead else 0
    cut = with_cuts(sliced(df, s), s).withColumnRenamed(SLICE, "_own")
    reach = F.sequence(slice_of(cut, s, f"{ORD} - {before}"), slice_of(cut, s, f"{ORD} + {after}"))
    cut = without_cuts(cut.withColumn("_reach", reach))
    near = cut.withColumn(SLICE, F.explode("_reach")).drop("_reach")
    return near.withColumn(HOME, F.col(SLICE) == F.col("_own")).drop("_own")


def running(
    df: DataFrame,
    s: Series,
    last: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns with unbounded frames.

    ``last``: last non-null value up to and including the row; ``prior``: the same without
    the row; ``upcoming``: first non-null value from the row on; ``sums``: running sum
    including the row.
    """
    base = sliced(df, s)
    last, prior, upcoming, sums = last or {}, prior or {}, upcoming or {}, sums or {}
    aggs, carry = [], []
    before = s.slices.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in the opposite order: frames that end at the last row
    # would be evaluated anew for every row
    after = Window.partitionBy(*s.keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for name, expr in (*last.items(), *prior.items()):
        aggs.append(F.max_by(expr, F.when(expr.isNotNull(), F.col(ORD))).alias(f"_in_{name}"))
        carry.append(F.last(f"_in_{name}", ignorenulls=True).over(before).alias(f"_in_{name}"))
    for name, expr in upcoming.items():
        aggs.append(F.min_by(expr, F.when(expr.isNotNull(), F.col(ORD))).alias(f"_in_{name}"))
        carry.append(F.last(f"_in_{name}", ignorenulls=True).over(after).alias(f"_in_{name}"))
    for name, expr in sums.items():
        aggs.append(F.sum(expr).alias(f"_in_{name}"))
        carry.append(F.sum(f"_in_{name}").over(before).alias(f"_in_{name}"))
    summary = base.groupBy(*s.keys, SLICE).agg(*aggs).select(*s.keys, SLICE, *carry)
    joined = base.join(summary, [*s.keys, SLICE])

    up_to = s.window.rowsBetween(Window.unboundedPreceding, 0)
    strictly = s.window.rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(*s.keys, SLICE).orderBy(F.col(ORD).desc())
    onward = backward.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for name, expr in last.items():
        out[name] = F.coalesce(F.last(expr, ignorenulls=True).over(up_to), F.col(f"_in_{name}"))
    for name, expr in prior.items():
        out[name] = F.coalesce(F.last(expr, ignorenulls=True).over(strictly), F.col(f"_in_{name}"))
    for name, expr in upcoming.items():
        out[name] = F.coalesce(F.last(expr, ignorenulls=True).over(onward), F.col(f"_in_{name}"))
    for name, expr in sums.items():
        here = F.coalesce(F.sum(expr).over(up_to), F.lit(0))
        out[name] = here + F.coalesce(F.col(f"_in_{name}"), F.lit(0))
    return joined.withColumns(out).drop(*[f"_in_{n}" for n in (*last, *prior, *upcoming, *sums)])
