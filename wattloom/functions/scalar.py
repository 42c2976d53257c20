"""Scalar expressions on power, temperature and time columns.

Thresholds default to the values of the control rules and are parameters throughout.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNAVAILABLE = ("unknown", "unavailable")

# fixed values: power bin edges in watts (right-closed) and half-open power bands
BIN_EDGES = (0, 200, 400, 600, 800, 1000, 1200, 1400, 1600, 1800, 5000)
DISTRIBUTION_BANDS = ((0, 500), (500, 800), (800, 1200), (1200, 5000))
ADAPTIVE_BANDS = ((0, 400), (400, 700), (700, 1000), (1000, 1500), (1500, 5000))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    x = _col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def coerce_numeric(x: Column | str) -> Column:
    """Number in a string, NULL where there is none (NaN counts as missing)."""
    number = _col(x).try_cast("double")
    return F.when(~F.isnan(number), number)


def phase(std: Column | str, stable: float = 50.0, unstable: float = 120.0) -> Column:
    std = _col(std)
    return F.when(std < stable, "stable").when(std > unstable, "unstable").otherwise("neutral")


def flag(condition: Column) -> Column:
    """Boolean that is False where the condition is unknown."""
    return F.coalesce(condition, F.lit(False))


def phase_flags(std: Column | str, stable: float = 50.0, unstable: float = 150.0) -> tuple[Column, Column]:
    std = _col(std)
    return flag(std < stable), flag(std > unstable)


def night_flags(std: Column | str, power: Column | str, calm: float = 40.0, on: float = 50.0) -> tuple[Column, Column]:
    """(stable, unstable) where unstable needs a running compressor."""
    std, power = _col(std), _col(power)
    return flag(std < calm), flag(std >= calm) & flag(power > on)


def cycling_risk_additive(std: Column | str, spread: Column | str, scale: float = 1.0) -> Column:
    """0-100 points; ``scale`` stretches the watt thresholds."""
    std, spread = _col(std), _col(spread)
    points = [
        (std > 50 * scale, 30),
        (std > 100 * scale, 30),
        (spread > 200 * scale, 20),
        (spread > 400 * scale, 20),
    ]
    total = sum((F.when(cond, score).otherwise(0) for cond, score in points), F.lit(0))
    return F.least(F.greatest(total, F.lit(0)), F.lit(100))


def risk_std(std: Column | str, full: float = 50.0) -> Column:
    return clip(_col(std) / full, 0, 1)


def risk_std_spread(std: Column | str, spread: Column | str, full_std: float = 50.0, full_spread: float = 400.0) -> Column:
    return clip(0.6 * clip(_col(std) / full_std, 0, 1) + 0.4 * clip(_col(spread) / full_spread, 0, 1), 0, 1)


def hour_sin(ts: Column | str) -> Column:
    return F.sin(F.hour(_col(ts)) * (2 * math.pi / 24))


def hour_cos(ts: Column | str) -> Column:
    return F.cos(F.hour(_col(ts)) * (2 * math.pi / 24))


def weekday(ts: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(_col(ts))


def is_weekend(ts: Column | str) -> Column:
    return (weekday(ts) >= 5).cast("int")


def hour_from_cyclic(sin: Column | str, cos: Column | str) -> Column:
    return F.pmod(F.atan2(_col(sin), _col(cos)) / (2 * math.pi) * 24 + 24, F.lit(24.0))


def is_night(ts: Column | str, timezone: str | None = None) -> Column:
    """23:00-06:00, in ``timezone`` when given."""
    ts = _col(ts)
    hour = F.hour(F.convert_timezone(None, F.lit(timezone), ts) if timezone else ts)
    return (hour >= 23) | (hour < 6)


def active_units(units: Sequence[Column | str], nonzero: bool = False) -> Column:
    """How many unit channels are on; an unknown channel counts as off."""
    on = []
    for u in units:
        u = F.coalesce(_col(u), F.lit(0.0))
        on.append(F.when((u != 0) if nonzero else (u > 0), 1).otherwise(0))
    return sum(on, F.lit(0))


def power_bin_right(power: Column | str, edges: Sequence[float] = BIN_EDGES) -> Column:
    """Right-closed bin label; the lowest edge belongs to the first bin, outside is NULL."""
    power = _col(power)
    out = F.when(power < edges[0], None)
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(power <= hi, f"{lo}-{hi}")
    return out


def power_band_left(power: Column | str, bands: Sequence[tuple[int, int]] = DISTRIBUTION_BANDS) -> Column:
    """Half-open band label, NULL outside."""
    power = _col(power)
    out = F.when(power < bands[0][0], None)
    for lo, hi in bands:
        out = out.when((power >= lo) & (power < hi), f"{lo}-{hi}")
    return out


def strip_entity_prefix(entity: Column | str) -> Column:
    return F.replace(_col(entity), F.lit("sensor."), F.lit(""))


def is_available(state: Column | str) -> Column:
    state = _col(state)
    return state.isNotNull() & ~state.isin(*UNAVAILABLE)


def is_on(hvac_mode: Column | str) -> Column:
    """An unknown (NULL) mode counts as on, a reported outage as off."""
    return F.coalesce(~_col(hvac_mode).isin("off", *UNAVAILABLE), F.lit(True))


def watts(x: Column | str) -> Column:
    """Whole watts as text, halves to even."""
    return F.bround(_col(x), 0).cast("long").cast("string")


def fixed_text(x: Column | str, digits: int = 1) -> Column:
    """Text with a fixed number of digits, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(_col(x), digits))


def range_text(lo: Column | str, hi: Column | str) -> Column:
    return F.concat(watts(lo), F.lit("-"), watts(hi), F.lit("W"))


def region_label(avg: Column | str, lo: Column | str, hi: Column | str, score: Column | str) -> Column:
    score = _col(score)
    mark = F.when(score > 0.75, " [STABIL]").when(score < 0.4, " [TAKTE]").otherwise("")
    return F.concat(watts(avg), F.lit("W avg ("), range_text(lo, hi), F.lit(")"), mark)


def stability_grade(median_std: Column | str, stable: float = 50.0, moderate: float = 100.0) -> Column:
    m = _col(median_std)
    return F.when(m < stable, "stable").when(m < moderate, "moderate").otherwise("unstable")


def dashboard_round(x: Column | str, digits: int = 3) -> Column:
    return F.bround(_col(x), digits)


def percent_int(x: Column | str) -> Column:
    return F.bround(_col(x) * 100, 0).cast("int")
