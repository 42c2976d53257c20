"""Statistics per series, cluster, class or period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import DISTRIBUTION_BANDS, flag, is_available
from wattloom.operators.windows import rolling_columns
from wattloom.series import ORD, SLICE, Series, home, plain, running, with_neighbours, with_time

_ALL = "_all"


#: distinct values of a key that are ranked in one part
PART_VALUES = 1_000_000
#: parts of a key with more; a power of two, as cuts are found by halving
PARTS = 256


def value_parts(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Number the part of each distinct value: parts of a key hold about equally many and follow each other.

    Cuts come from a mergeable quantile sketch of each key with more than ``PART_VALUES`` values, so they follow the
    values whatever their range; ranks inside are exact.
    """
    large = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > PART_VALUES).select(*keys)
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = counts.join(large, list(keys), "left_semi").groupBy(*keys).agg(F.percentile_approx(value, shares, 20 * PARTS).alias("_cuts"))
    steps, step = [], PARTS // 2
    while step:
        steps.append(F.lit(step))
        step //= 2

    def halved(i, n):
        return i + F.when(F.col("_cuts")[i + n - 1] < F.col(value), n).otherwise(0)

    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.aggregate(F.array(*steps), F.lit(0), halved))
    # one row of cuts a large key: broadcast when few, and split by adaptive execution when a key is hot
    return counts.join(cuts, list(keys), "left").withColumn(out, part).drop("_cuts")


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbouring ranks.

    Rows are first counted per distinct value, then ranked by running counts over parts of about equally many values,
    so no task ever holds all values of a key.
    """
    grouped = df.filter(F.col(col).isNotNull())
    if not keys:
        grouped, keys = grouped.withColumn(_ALL, F.lit(0)), (_ALL,)
    counts = grouped.groupBy(*keys, F.col(col).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = value_parts(counts, keys, "_v", SLICE).join(totals, list(keys)).withColumn(ORD, F.col("_v"))
    ranked = running(placed, Series(keys=tuple(keys)), sums={"_cum": F.col("_n")})
    aggs, out = [], {}
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))
            aggs.append(F.max(F.when(covers, F.col("_v"))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out[name] = lo + (hi - lo) * F.col(f"_{name}_f")
    result = ranked.groupBy(*keys).agg(*aggs).withColumns(out)
    return result.select(*[k for k in keys if k != _ALL], *probs)


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def power_stats(df: DataFrame, keys: Sequence[str], col: str = "value") -> DataFrame:
    """count, min, max, mean, std and quartiles per key."""
    basic = df.groupBy(*keys).agg(
        F.count(col).alias("count"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
    )
    return basic.join(quantiles(df, keys, col, QUARTILES), list(keys), "left")


def describe_transitions(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same statistics per column, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return power_stats(long.filter("value is not null"), ("column",))


def with_stability(df: DataFrame, s: Series, n: int = 10, prefix: str = "power") -> DataFrame:
    """Rolling std and spread over the last n rows."""
    near = with_neighbours(df, s, back=n - 1).withColumns(rolling_columns(s, n, prefix, ("std", "min", "max")))
    near = plain(near).withColumn(f"{prefix}_spread", F.col(f"{prefix}_max") - F.col(f"{prefix}_min"))
    return near.drop(f"{prefix}_min", f"{prefix}_max")


def stability_shares(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    std: str = "power_std",
    spread: str = "power_spread",
    stable: float = 50.0,
    low_power: float = 600.0,
    cycling_std: float = 100.0,
    cycling_spread: float = 400.0,
) -> DataFrame:
    """Percent of rows that are stable, stable at low power, and cycling; unknown counts as no."""

    def pct(cond: Column) -> Column:
        return F.avg(flag(cond).cast("int")) * 100

    calm = F.col(std) < stable
    return df.groupBy(*keys).agg(
        pct(calm).alias("stable_pct"),
        pct(calm & (F.col(value) < low_power)).alias("low_power_stable_pct"),
        pct(flag(F.col(std) > cycling_std) | flag(F.col(spread) > cycling_spread)).alias("cycling_pct"),
        F.avg(std).alias("mean_std"),
    )


def quantile_threshold(df: DataFrame, keys: Sequence[str], col: str = "power_std", q: float = 0.25, out: str = "stable_quantile") -> DataFrame:
    """Flag the rows strictly below the q-quantile of their key."""
    cut = quantiles(df, keys, col, {"threshold": q})
    return df.join(cut, list(keys)).withColumn(out, flag(F.col(col) < F.col("threshold")))


def adaptive_thresholds(df: DataFrame, keys: Sequence[str], band: str = "band", col: str = "power_std", min_rows: int = 100, q: float = 0.25) -> DataFrame:
    """Per power band with more than ``min_rows`` rows: the q-quantile and the share below it."""
    group = [*keys, band]
    banded = df.filter(F.col(band).isNotNull())
    sizes = banded.groupBy(*group).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > min_rows)
    cuts = quantiles(banded.join(sizes.drop("rows"), group, "left_semi"), group, col, {"threshold": q})
    return (
        banded.join(cuts, group)
        .groupBy(*group, "threshold")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(col) < F.col("threshold")).alias("stable_rows"))
        .withColumn("stable_pct", F.col("stable_rows") / F.col("rows") * 100)
    )


def band_distribution(df: DataFrame, keys: Sequence[str], value: str = "value", bands: Sequence[tuple[int, int]] = DISTRIBUTION_BANDS) -> DataFrame:
    """Rows and percent per half-open band; empty bands appear with 0."""
    names = [f"{lo}-{hi}" for lo, hi in bands]
    hits = [
        F.count_if((F.col(value) >= lo) & (F.col(value) < hi)).alias(name) for (lo, hi), name in zip(bands, names)
    ]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), *hits)
    long = counted.unpivot([*keys, "_total"], names, "band", "rows")
    return long.withColumn("pct", F.col("rows") / F.col("_total") * 100).drop("_total")


def corr_with_target(df: DataFrame, target: str, cols: Sequence[str], top: int | None = 10, min_abs: float = 0.0, strong: float = 0.3) -> DataFrame:
    """Pearson r of the target with each column over the rows that have both, by |r|.

    One aggregation for all columns; ``strength`` marks r beyond +-``strong``.
    """
    rs = df.agg(*[F.corr(F.col(target).cast("double"), F.col(c).cast("double")).alias(c) for c in cols])
    ranked = rs.unpivot([], list(cols), "feature", "r").filter(F.col("r").isNotNull() & ~F.isnan("r"))
    ranked = ranked.filter(F.abs("r") > min_abs) if min_abs else ranked
    mark = F.when(F.col("r") > strong, "up").when(F.col("r") < -strong, "down").otherwise("")
    ranked = ranked.withColumn("strength", mark).orderBy(F.desc(F.abs("r")), "feature")
    return ranked.limit(top) if top else ranked


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form: (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    rs = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = rs.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    half = long.select(F.split("pair", r"\|").alias("p"), "r")
    both = half.select(F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "r")
    return both.unionByName(both.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def mode_value(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Most frequent value per key; the smallest one on a tie."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("rows"))
    best = F.min(F.struct((-F.col("rows")).alias("neg"), col)).alias("_b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col(f"_b.{col}").alias(col), (-F.col("_b.neg")).alias("rows"))


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(*keys, F.desc("count"), col)


def histogram(df: DataFrame, keys: Sequence[str], col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value of each key.

    The last bin is closed; bins without rows appear with 0.
    """
    spans = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    share = F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bin_no = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
    rows = df.filter(F.col(col).isNotNull()).join(spans, list(keys)).groupBy(*keys, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    width = (F.col("_hi") - F.col("_lo")) / bins
    full = every.join(rows, [*keys, "bin"], "left")
    return full.select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def hour_distribution(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("rows"))


def cluster_stats(df: DataFrame, cluster: str = "cluster", power: str = "power", std: str = "power_std", outdoor: str | None = "outdoor_temp", keys: Sequence[str] = ()) -> DataFrame:
    """Size, mean and median of power and std, and mean outdoor temperature per cluster."""
    group = [*keys, cluster]
    aggs = [
        F.count(F.lit(1)).alias("size"),
        F.avg(power).alias("power_mean"),
        F.avg(std).alias("power_std_mean"),
    ]
    if outdoor:
        aggs.append(F.avg(outdoor).alias("outdoor_temp_mean"))
    basic = df.groupBy(*group).agg(*aggs)
    power_median = quantiles(df, group, power, {"power_median": 0.5})
    std_median = quantiles(df, group, std, {"power_std_median": 0.5})
    return basic.join(power_median, group, "left").join(std_median, group, "left").orderBy("power_std_median")


def transition_change_counts(deltas: DataFrame, cols: Sequence[str], above: float = 0.1) -> DataFrame:
    """Mean delta and number of deltas beyond ``above`` per channel."""
    long = deltas.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "channel", "delta")
    return long.groupBy("channel").agg(
        F.avg("delta").alias("mean_delta"),
        F.count_if(F.abs("delta") > above).alias("changes"),
        F.count(F.lit(1)).alias("transitions"),
    )


def total_power(readings: DataFrame, units: DataFrame, site: str = "site_id", unit: str = "unit_id", state: str = "state", ts: str = "ts") -> DataFrame:
    """Sum of the latest power of all units of a site.

    An unavailable unit is skipped; in a site with a single unit it leaves the total unknown.
    """
    newest = readings.groupBy(site, unit).agg(F.max_by(state, ts).alias("_state"))
    known = units.select(site, unit).join(newest, [site, unit], "left")
    watts = F.when(is_available("_state"), F.col("_state").try_cast("double"))
    sums = known.groupBy(site).agg(F.sum(watts).alias("_sum"), F.count(F.lit(1)).alias("units"))
    total = F.when(F.col("units") == 1, F.col("_sum")).otherwise(F.coalesce("_sum", F.lit(0.0)))
    return sums.select(site, "units", total.alias("total_power"))


def comfort_emergency(rooms: DataFrame, cycle: Sequence[str], cold: float = 1.5, warm: float = 1.0) -> DataFrame:
    """Per cycle: is any room too cold or too warm, and which ones (a site has few rooms)."""
    off = (F.col("delta") < -cold) | (F.col("delta") > warm)
    return rooms.groupBy(*cycle).agg(
        flag(F.bool_or(off)).alias("comfort_emergency"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.when(off, F.col("room"))))).alias("offending_rooms"),
    )


def stability_emergency(
    df: DataFrame,
    s: Series,
    bucket: str = "1 minute",
    width: str = "15 minutes",
    max_std: float = 300.0,
    max_range: float = 800.0,
    min_points: int = 5,
) -> DataFrame:
    """Per bucket: did power oscillate over the bucket means of the last ``width``."""
    from wattloom.operators.scan import resample_mean
    from wattloom.series import micros

    means = resample_mean(df, s, bucket)
    b = replace(s, ts="bucket")
    frame = b.window.rangeBetween(-micros(width), 0)
    near = with_time(means, b, back=width).withColumns(
        {
            "points": F.count(s.value).over(frame),
            "power_std": F.stddev_samp(s.value).over(frame),
            "power_range": F.max(s.value).over(frame) - F.min(s.value).over(frame),
        }
    )
    hit = (F.col("points") >= min_points) & ((F.col("power_std") > max_std) | (F.col("power_range") > max_range))
    return plain(near.withColumn("stability_emergency", flag(hit)))


# fixed values: messages of the sufficiency check
MSG_EMPTY = "Keine Daten vorhanden."
MSG_FEW = "Zu wenige Datenpunkte (%d). Benötigt mindestens %d."
MSG_SHORT = "Zu kurzer Zeitraum (%.1fh). Benötigt mindestens %dh."
MSG_OK = "Ausreichend: %d Punkte über %.1fh"


def data_sufficiency(df: DataFrame, s: Series, min_rows: int = 1000, min_hours: int = 24) -> DataFrame:
    us = F.unix_micros(s.ts)
    seen = df.groupBy(*s.keys).agg(
        F.count(F.lit(1)).alias("rows"), ((F.max(us) - F.min(us)) / F.lit(3600e6)).alias("hours")
    )
    few, short = F.col("rows") < min_rows, F.col("hours") < min_hours
    message = (
        F.when(F.col("rows") == 0, MSG_EMPTY)
        .when(few, F.format_string(MSG_FEW, "rows", F.lit(min_rows)))
        .when(short, F.format_string(MSG_SHORT, "hours", F.lit(min_hours)))
        .otherwise(F.format_string(MSG_OK, "rows", "hours"))
    )
    return seen.withColumns({"sufficient": ~(few | short), "message": message})


def data_quality(df: DataFrame, s: Series) -> DataFrame:
    """1, less half the missing share, less 0.4 for a flat line; never below 0."""
    missing = 1 - F.count(s.value) / F.count(F.lit(1))
    flat = F.when(F.stddev_samp(s.value) < 5, 0.4).otherwise(0.0)
    return df.groupBy(*s.keys).agg(F.greatest(F.lit(0.0), 1 - missing * 0.5 - flat).alias("data_quality_score"))


def class_balance(df: DataFrame, label: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def room_mode_validation(rooms_with_unit: DataFrame, site: str = "site_id") -> DataFrame:
    """Rooms and modes per unit; the mode belongs to the unit, so it cannot be mixed."""
    return rooms_with_unit.filter("unit_id is not null").groupBy(site, "unit_id").agg(
        F.count(F.lit(1)).alias("rooms"),
        F.min("operating_mode").alias("operating_mode"),
        (F.min("operating_mode").eqNullSafe(F.max("operating_mode"))).alias("valid"),
    )


def critical_room(rooms: DataFrame, cycle: Sequence[str]) -> DataFrame:
    """The room with the largest deviation per cycle; the first name on a tie."""
    worst = F.min(F.struct((-F.abs("delta")).alias("neg"), F.col("room").alias("room"), F.col("delta").alias("delta")))
    found = rooms.filter("delta is not null").groupBy(*cycle).agg(worst.alias("_w"))
    return found.select(*cycle, F.col("_w.room").alias("critical_room"), F.col("_w.delta").alias("delta"))


def kpi_rollup(
    readings: DataFrame,
    cycles: DataFrame,
    deviations: DataFrame,
    actions: DataFrame,
    keys: Sequence[str],
    stable: float = 50.0,
    low_power: float = 600.0,
) -> DataFrame:
    """Daily goals per key.

    ``readings`` has (ts, value, power_std), ``cycles`` (start, duration_minutes),
    ``deviations`` (ts, delta) and ``actions`` (ts); each is aggregated per day first.
    """
    calm = F.col("power_std") < stable
    by = [*keys, "date"]
    power = readings.withColumn("date", F.to_date("ts")).groupBy(*by).agg(
        (F.avg(flag(calm).cast("int")) * 100).alias("stable_pct"),
        (F.try_divide(F.count_if(calm & (F.col("value") < low_power)), F.count_if(calm)) * 100).alias(
            "low_power_share_pct"
        ),
    )
    cycling = cycles.withColumn("date", F.to_date("start")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("cycles"), F.avg("duration_minutes").alias("avg_cycle_minutes")
    )
    comfort = deviations.withColumn("date", F.to_date("ts")).groupBy(*by).agg(
        F.sqrt(F.avg(F.col("delta") * F.col("delta"))).alias("rms_deviation")
    )
    acted = actions.withColumn("date", F.to_date("ts")).groupBy(*by).agg(F.count(F.lit(1)).alias("actions"))
    out = power.join(cycling, by, "full").join(comfort, by, "full").join(acted, by, "full")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cycles", "actions")})


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows per actual x predicted class, including combinations that do not occur."""
    grid = [(a, p) for a in classes for p in classes]
    cells = [
        F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"{a},{p}") for a, p in grid
    ]
    long = df.agg(*cells).unpivot([], [f"{a},{p}" for a, p in grid], "cell", "rows")
    cell = F.split("cell", ",")
    return long.select(cell[0].cast("int").alias("actual"), cell[1].cast("int").alias("predicted"), "rows")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """precision, recall, f1 and support per class, accuracy, macro and weighted averages."""
    hit = F.col(label) == F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("ok")]
    for c in classes:
        aggs += [
            F.count_if(hit & (F.col(label) == c)).alias(f"tp{c}"),
            F.count_if(F.col(prediction) == c).alias(f"pp{c}"),
            F.count_if(F.col(label) == c).alias(f"sp{c}"),
        ]

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    rows, parts = [], {}
    for c in classes:
        p = ratio(F.col(f"tp{c}"), F.col(f"pp{c}"))
        r = ratio(F.col(f"tp{c}"), F.col(f"sp{c}"))
        parts[c] = (p, r, ratio(2 * p * r, p + r), F.col(f"sp{c}"))
        rows.append((str(c), *parts[c]))
    acc = ratio(F.col("ok"), F.col("n"))
    rows.append(("accuracy", acc, acc, acc, F.col("n")))
    k = float(len(classes))
    macro = [sum((parts[c][i] for c in classes), F.lit(0.0)) / k for i in range(3)]
    weighted = [ratio(sum((parts[c][i] * parts[c][3] for c in classes), F.lit(0.0)), F.col("n")) for i in range(3)]
    rows += [("macro avg", *macro, F.col("n")), ("weighted avg", *weighted, F.col("n"))]
    names = ("class", "precision", "recall", "f1", "support")
    table = F.array(*[F.struct(F.lit(r[0]).alias(names[0]), *[x.alias(n) for x, n in zip(r[1:], names[1:])]) for r in rows])
    return df.agg(*aggs).select(F.inline(table))


def night_report(df: DataFrame, s: Series, n: int = 10, on: float = 50.0, calm: float = 40.0, target: tuple[float, float] = (400.0, 500.0)) -> DataFrame:
    """Running time, instability, cycles and power per series; zeros where nothing ran."""
    near = with_neighbours(df, s, back=n - 1).withColumns(rolling_columns(s, n, "power", ("std",)))
    running_now = flag(F.col(s.value) > on)
    near = near.withColumns(
        {"_on": running_now.cast("int"), "_was": F.lag(running_now.cast("int")).over(s.window)}
    )
    on_row = F.col("_on") == 1
    rows = home(near)
    agg = rows.groupBy(*s.keys).agg(
        F.sum("_on").alias("on_rows"),
        F.count_if(on_row & (F.col("power_std") >= calm)).alias("_unstable"),
        F.avg(F.when(on_row, F.col(s.value))).alias("_avg"),
        (F.sum(F.abs(F.col("_on") - F.col("_was"))) / 2).alias("_cycles"),
        F.count_if(on_row & F.col(s.value).between(*target)).alias("_target"),
        F.min(F.when(on_row, F.col(s.value))).alias("_min"),
        F.max(F.when(on_row, F.col(s.value))).alias("_max"),
    )

    def when_on(x: Column) -> Column:
        return F.when(F.col("on_rows") > 0, x).otherwise(F.lit(0.0))

    return agg.select(
        *s.keys,
        "on_rows",
        when_on(F.col("_unstable") / F.col("on_rows") * 100).alias("unstable_pct"),
        when_on(F.col("_avg")).alias("avg_power"),
        when_on(F.coalesce("_cycles", F.lit(0.0))).alias("cycles"),
        when_on(F.col("_target") / F.col("on_rows") * 100).alias("target_zone_pct"),
        when_on(F.col("_min")).alias("min_power"),
        when_on(F.col("_max")).alias("max_power"),
    )
