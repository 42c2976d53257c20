"""Window operators; each one works per series and time slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattloom.series import ORD, SLICE, Series, micros, plain, running, sliced, with_neighbours

STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def rolling_columns(s: Series, n: int, prefix: str, stats: Sequence[str], value: str | None = None) -> dict[str, Column]:
    """Rolling statistics over the last ``n`` rows, for a frame that has its neighbours."""
    frame = s.window.rowsBetween(-(n - 1), 0)
    return {f"{prefix}_{k}": STATS[k](value or s.value).over(frame) for k in stats}


def lag_phase(df: DataFrame, s: Series, col: str, out: str | None = None) -> DataFrame:
    """Value of the previous row."""
    out = out or f"prev_{col}"
    return plain(with_neighbours(df, s, back=1).withColumn(out, F.lag(col).over(s.window)))


def diff_n(df: DataFrame, s: Series, n: int = 1, out: str = "diff", fill: float | None = None) -> DataFrame:
    """Value minus the value n rows earlier; ``fill`` replaces the missing start."""
    d = F.col(s.value) - F.lag(s.value, n).over(s.window)
    d = d if fill is None else F.coalesce(d, F.lit(float(fill)))
    return plain(with_neighbours(df, s, back=n).withColumn(out, d))


def rolling_rows(df: DataFrame, s: Series, n: int, prefix: str = "roll", stats: Sequence[str] = tuple(STATS)) -> DataFrame:
    """Statistics over the last n rows, from one row on; std of a single row is NULL."""
    return plain(with_neighbours(df, s, back=n - 1).withColumns(rolling_columns(s, n, prefix, stats)))


def power_spread(df: DataFrame, s: Series, n: int = 10, out: str = "spread") -> DataFrame:
    frame = s.window.rowsBetween(-(n - 1), 0)
    spread = F.max(s.value).over(frame) - F.min(s.value).over(frame)
    return plain(with_neighbours(df, s, back=n - 1).withColumn(out, spread))


def power_gradient(df: DataFrame, s: Series, n: int = 6, out: str = "gradient", absolute: bool = False) -> DataFrame:
    """Mean of the last n row-to-row differences, NULL until there are n of them."""
    near = with_neighbours(df, s, back=n).withColumn("_d", F.col(s.value) - F.lag(s.value).over(s.window))
    frame = s.window.rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("_d").over(frame) == n, F.avg("_d").over(frame))
    return plain(near.withColumn(out, F.abs(mean) if absolute else mean)).drop("_d")


_BLOCK, _POS, _KIND = "_block", "_pos", "_kind"
_OWN, _FORMER, _LATTER = 0, 1, 2
_PARTS = {
    "mean": {"n": F.count, "sum": F.sum},
    "std": {"n": F.count, "sum": F.sum, "var": F.var_pop},
    "min": {"min": F.min},
    "max": {"max": F.max},
}


def _merged(stat: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A statistic of two sets of rows from their parts."""
    if stat in ("min", "max"):
        return (F.least if stat == "min" else F.greatest)(a[stat], b[stat])
    n = a["n"] + b["n"]
    total = F.coalesce(a["sum"], F.lit(0)) + F.coalesce(b["sum"], F.lit(0))
    if stat == "mean":
        return F.when(n > 0, total / n)
    # spreads add up with the distance of the means: nothing is subtracted that could cancel
    apart = b["sum"] / b["n"] - a["sum"] / a["n"]
    between = F.when((a["n"] > 0) & (b["n"] > 0), apart * apart * (a["n"] / n) * b["n"]).otherwise(0.0)
    within = F.coalesce(a["var"] * a["n"], F.lit(0.0)) + F.coalesce(b["var"] * b["n"], F.lit(0.0))
    return F.when(n > 1, F.sqrt((within + between) / (n - 1)))


def over_time(df: DataFrame, s: Series, back: Mapping[str, tuple[str, str]] | None = None, ahead: Mapping[str, tuple[str, str]] | None = None, reach: int = 0) -> DataFrame:
    """Add statistics of the rows in ``[t - reach, t]`` (``back``) and in ``[t, t + reach]`` (``ahead``), microseconds.

    Both map a new column to (statistic, column). Time is cut into blocks as long as the frame, so a frame is the
    end of one block and the start of the next. Rows of the block before are moved on by ``reach``: those in the frame of a
    row then stand at or after it, and the rows of its own block at or before it. Both sides are running aggregates,
    so a row costs the same whatever its frame holds. The frame of a row without a time is all such rows of its series.
    """
    back, ahead = back or {}, ahead or {}
    kinds = [_OWN] + [_FORMER] * bool(back) + [_LATTER] * bool(ahead)
    us, kind, length = F.unix_micros(s.ts), F.col(_KIND), reach + 1
    used = dict.fromkeys(c for _, c in (*back.values(), *ahead.values()))
    place = F.expr(f"(unix_micros({s.ts}) - pmod(unix_micros({s.ts}), {length}L)) div {length}L")
    dealt = df.select("*", F.explode(F.array(*[F.lit(k) for k in kinds])).alias(_KIND)).filter((kind == _OWN) | F.col(s.ts).isNotNull())
    rest = [c for c in df.columns if c not in s.keys and c not in used]
    dealt = dealt.select(
        *s.keys,
        *used,
        # a moved row is there for its values only
        *[F.when(kind == _OWN, F.col(c)).alias(c) for c in rest],
        _KIND,
        (place + F.when(kind == _FORMER, 1).when(kind == _LATTER, -1).otherwise(0)).alias(_BLOCK),
        (us + F.when(kind == _FORMER, reach).when(kind == _LATTER, -reach).otherwise(0)).alias(_POS),
    )
    block = Window.partitionBy(*s.keys, _BLOCK)
    so_far = block.orderBy(F.col(_POS).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = block.orderBy(F.col(_POS).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    parts: dict[str, Column] = {}

    def part(stat: str, col: str, of: int, over: WindowSpec, side: str) -> dict[str, Column]:
        names = {k: f"_{k}_{of}{side}_{col}" for k in _PARTS[stat]}
        parts.update({names[k]: fn(F.when(kind == of, F.col(col))).over(over) for k, fn in _PARTS[stat].items()})
        return {k: F.col(n) for k, n in names.items()}

    out = {name: _merged(stat, part(stat, c, _FORMER, from_here, "f"), part(stat, c, _OWN, so_far, "s")) for name, (stat, c) in back.items()}
    out |= {name: _merged(stat, part(stat, c, _OWN, from_here, "f"), part(stat, c, _LATTER, so_far, "s")) for name, (stat, c) in ahead.items()}
    framed = dealt.withColumns(parts).filter(kind == _OWN)
    return framed.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def rolling_time(df: DataFrame, s: Series, width: str = "10 minutes", prefix: str = "roll", stats: Sequence[str] = tuple(STATS)) -> DataFrame:
    """Statistics over ``(t - width, t]`` - open on the left."""
    return over_time(df, s, back={f"{prefix}_{k}": (k, s.value) for k in stats}, reach=micros(width) - 1)


def with_direction_changes(df: DataFrame, s: Series) -> DataFrame:
    """``sign`` of the step from the previous row and ``turn`` (0/1) where it changes.

    Keeps the neighbouring rows: two before and one after each slice.
    """
    near = with_neighbours(df, s, back=2, ahead=1)
    step = F.coalesce(F.col(s.value) - F.lag(s.value).over(s.window), F.lit(0.0))
    near = near.withColumn("sign", F.signum(step))
    # the second neighbour has no predecessor here, but only a home row reads two rows back
    before = F.lag("sign").over(s.window)
    return near.withColumn("turn", F.coalesce((F.col("sign") != before).cast("int"), F.lit(0)))


def direction_changes(df: DataFrame, s: Series) -> DataFrame:
    return plain(with_direction_changes(df, s))


def forward_window(df: DataFrame, s: Series, n: int = 10, out: str = "ahead_sum") -> DataFrame:
    """Sum over the row and the next n - 1 rows."""
    total = F.sum(s.value).over(s.window.rowsBetween(0, n - 1))
    return plain(with_neighbours(df, s, ahead=n - 1).withColumn(out, total))


def trailing_exclusive(df: DataFrame, s: Series, n: int = 30, prefix: str = "power") -> DataFrame:
    """Mean and population std of the n rows before the row; rows without n such rows go."""
    frame = s.window.rowsBetween(-n, -1)
    out = with_neighbours(df, s, back=n).withColumns(
        {
            f"{prefix}_mean": F.avg(s.value).over(frame),
            f"{prefix}_std": F.stddev_pop(s.value).over(frame),
            "_n": F.count(F.lit(1)).over(frame),
        }
    )
    return plain(out.filter(F.col("_n") == n)).drop("_n")


def islands(df: DataFrame, s: Series, col: str, out: str = "run_id") -> DataFrame:
    """Number of the run of equal values the row is in, from 1.

    Changes are counted within each slice; whether a slice begins with a change follows from
    the last value of the slice before.
    """
    inside = F.lag(ORD).over(s.window).isNotNull()
    changed = ~F.col(col).eqNullSafe(F.lag(col).over(s.window))
    marked = sliced(df, s).withColumn("_new", (inside & changed).cast("long"))
    ends = marked.groupBy(*s.keys, SLICE).agg(
        F.sum("_new").alias("_n"),
        F.min_by(F.struct(col), ORD).alias("_first"),
        F.max_by(F.struct(col), ORD).alias("_last"),
    )
    begins = (~F.col("_first").eqNullSafe(F.lag("_last").over(s.slices))).cast("long")
    ends = ends.withColumn("_begins", begins)
    before = s.slices.rowsBetween(Window.unboundedPreceding, -1)
    up_to = s.slices.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.sum("_begins").over(up_to)
    joined = marked.join(ends.select(*s.keys, SLICE, start.alias("_start")), [*s.keys, SLICE])
    here = F.sum("_new").over(s.window.rowsBetween(Window.unboundedPreceding, 0))
    return plain(joined.withColumn(out, F.col("_start") + here)).drop("_new", "_start")


def run_counter(df: DataFrame, s: Series, on: str, out: str = "runtime") -> DataFrame:
    """Consecutive on rows up to the row; 0 on every off row.

    Counted within each slice; up to the first off row of a slice, what the slices before
    left running is added.
    """
    up_to = s.window.rowsBetween(Window.unboundedPreceding, 0)
    is_on = F.coalesce(F.col(on).cast("boolean"), F.lit(False))
    local = sliced(df, s).withColumn("_on", F.sum(is_on.cast("long")).over(up_to))
    local = local.withColumn("_off", F.last(F.when(~is_on, F.col("_on")), ignorenulls=True).over(up_to))
    local = local.withColumn("_run", F.col("_on") - F.coalesce("_off", F.lit(0)))
    ends = local.groupBy(*s.keys, SLICE).agg(
        F.max_by("_run", ORD).alias("_tail"), F.bool_or(F.col("_off").isNotNull()).alias("_cut")
    )
    so_far = s.slices.rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_sum", F.sum("_tail").over(so_far))
    cut_at = F.last(F.when(F.col("_cut"), F.col("_sum") - F.col("_tail")), ignorenulls=True).over(so_far)
    ends = ends.withColumn("_left", F.col("_sum") - F.coalesce(cut_at, F.lit(0)))
    carry = ends.select(*s.keys, SLICE, F.coalesce(F.lag("_left").over(s.slices), F.lit(0)).alias("_carry"))
    joined = local.join(carry, [*s.keys, SLICE])
    runtime = F.col("_run") + F.when(F.col("_off").isNull(), F.col("_carry")).otherwise(0)
    return plain(joined.withColumn(out, runtime)).drop("_on", "_off", "_run", "_carry")


def ffill(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Carry the last known value forward."""
    filled = running(df, s, last={f"_f_{c}": F.col(c) for c in cols})
    return plain(filled.withColumns({c: F.col(f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols]))


def bfill(df: DataFrame, s: Series, cols: Sequence[str]) -> DataFrame:
    """Carry the next known value backward."""
    filled = running(df, s, upcoming={f"_b_{c}": F.col(c) for c in cols})
    return plain(filled.withColumns({c: F.col(f"_b_{c}") for c in cols}).drop(*[f"_b_{c}" for c in cols]))


def row_index(df: DataFrame, s: Series, out: str = "row_no") -> DataFrame:
    """Position of the row in its series, from 1."""
    return plain(running(df, s, sums={out: F.lit(1).cast("long")}))


def sample_every_nth(df: DataFrame, s: Series, n: int, start: int = 0) -> DataFrame:
    """Rows start, start + n, start + 2n, ... of each series (counted from 0)."""
    at = F.col("_no") - 1 - start
    return row_index(df, s, "_no").filter((at >= 0) & (F.pmod(at, F.lit(n)) == 0)).drop("_no")


def rank_topk(df: DataFrame, by: Sequence[Column], n: int, partition: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """The first n rows in the given order, per group or overall.

    A filter on row_number lets Spark keep n rows per group and task before the shuffle.
    """
    if partition:
        ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*by)))
        return ranked.filter(F.col(out) <= n)
    top = df.orderBy(*by).limit(n)
    # n rows only
    return top.withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)))
