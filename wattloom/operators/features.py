"""Features, labels and sampling for the instability models."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.functions.scalar import flag, hour_cos, hour_sin, is_weekend
from wattloom.operators.windows import run_counter
from wattloom.series import ORD, SLICE, Series, constant, plain, running, sliced, with_neighbours

PREDICTOR_FEATURES = (
    "power", "power_trend", "power_std", "hour", "outdoor_temp", "power_diff", "power_diff_abs", "compressor_runtime", "active_units",
)


def label_binary(df: DataFrame, std: str, stable: float = 50.0, unstable: float = 120.0, out: str = "target") -> DataFrame:
    """1 for unstable, 0 for stable rows; neutral rows go."""
    kept = df.filter((F.col(std) < stable) | (F.col(std) > unstable))
    return kept.withColumn(out, (F.col(std) > unstable).cast("int"))


def _changed(s: Series, col: str) -> Column:
    return flag(F.abs(F.col(col) - F.lag(col).over(s.window)) > 0.1).cast("int")


def target_changed(df: DataFrame, s: Series, targets: Sequence[str], any_out: str = "any_target_changed") -> DataFrame:
    """0/1 per target whether it moved by more than 0.1 since the previous row, and any of them."""
    near = with_neighbours(df, s, back=1).withColumns({f"{c}_changed": _changed(s, c) for c in targets})
    return plain(near.withColumn(any_out, _any([f"{c}_changed" for c in targets])))


def _any(cols: Sequence[str]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])


def _gradient(s: Series, diff: str, n: int = 6) -> Column:
    frame = s.window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(diff).over(frame) == n, F.avg(diff).over(frame))


def _deltas(rooms: Mapping[str, tuple[str, str]]) -> dict[str, Column]:
    out = {}
    for room, (temp, target) in rooms.items():
        out[f"delta_{room}"] = F.col(temp) - F.col(target)
        out[f"delta_{room}_abs"] = F.abs(F.col(temp) - F.col(target))
    return out


def _power_shape(s: Series, n: int = 6) -> dict[str, Column]:
    frame = s.window.rowsBetween(-(n - 1), 0)
    return {
        "power_std": F.stddev_samp(s.value).over(frame),
        "power_spread": F.max(s.value).over(frame) - F.min(s.value).over(frame),
    }


def symptom_features(df: DataFrame, s: Series, rooms: Mapping[str, tuple[str, str]], outdoor: str = "outdoor_temp") -> DataFrame:
    """Power level and shape, outdoor gradient, room deviations and time of day."""
    near = with_neighbours(df, s, back=6).withColumns(
        {
            "_dp": F.col(s.value) - F.lag(s.value).over(s.window),
            "_do": F.col(outdoor) - F.lag(outdoor).over(s.window),
        }
    )
    near = near.withColumns(
        {
            **_power_shape(s),
            "power_gradient": _gradient(s, "_dp"),
            "outdoor_gradient": _gradient(s, "_do"),
            **_deltas(rooms),
            "hour_sin": hour_sin(s.ts),
            "hour_cos": hour_cos(s.ts),
        }
    )
    return plain(near).drop("_dp", "_do")


def symptom_feature_names(rooms: Sequence[str]) -> list[str]:
    return [
        "power", "power_std", "power_gradient", "power_spread", "outdoor_temp", "outdoor_gradient",
        *[f"delta_{r}" for r in rooms], *[f"delta_{r}_abs" for r in rooms], "hour_sin", "hour_cos",
    ]


def causal_features(df: DataFrame, s: Series, rooms: Mapping[str, tuple[str, str]], outdoor: str = "outdoor_temp") -> DataFrame:
    """External conditions only; std and spread are kept for labelling, not as features."""
    targets = [target for _, target in rooms.values()]
    near = with_neighbours(df, s, back=6).withColumns(
        {
            **_power_shape(s),
            "power_level": F.col(s.value),
            "outdoor_temp_norm": F.col(outdoor),
            "outdoor_temp_change": F.col(outdoor) - F.lag(outdoor, 6).over(s.window),
            **_deltas(rooms),
            **{f"{c}_changed": _changed(s, c) for c in targets},
            "hour_sin": hour_sin(s.ts),
            "hour_cos": hour_cos(s.ts),
            "is_weekend": is_weekend(s.ts),
        }
    )
    total = sum((F.coalesce(f"delta_{r}_abs", F.lit(0.0)) for r in rooms), F.lit(0.0))
    near = near.withColumns({"total_delta_abs": total, "any_target_changed": _any([f"{c}_changed" for c in targets])})
    return plain(near).drop(*[f"{c}_changed" for c in targets])


def causal_feature_names(rooms: Sequence[str]) -> list[str]:
    return [
        "power_level", "outdoor_temp_norm", "outdoor_temp_change",
        *[f"delta_{r}" for r in rooms], *[f"delta_{r}_abs" for r in rooms],
        "total_delta_abs", "any_target_changed", "hour_sin", "hour_cos", "is_weekend",
    ]


def predictor_features(df: DataFrame, s: Series, compressor: str | None = None, outdoor: str | None = None, units: str | None = None) -> DataFrame:
    """The inputs of the cycling predictor; absent optional channels are 0."""
    if compressor:
        df = run_counter(df, s, compressor, "compressor_runtime")
    else:
        df = df.withColumn("compressor_runtime", F.lit(0).cast("long"))
    frame = s.window.rowsBetween(-9, 0)
    step = F.coalesce(F.col(s.value) - F.lag(s.value).over(s.window), F.lit(0.0))
    near = with_neighbours(df, s, back=9).withColumns(
        {
            "power": F.col(s.value),
            "power_trend": F.avg(s.value).over(frame),
            "power_std": F.coalesce(F.stddev_samp(s.value).over(frame), F.lit(0.0)),
            "hour": F.hour(s.ts),
            "outdoor_temp": F.col(outdoor) if outdoor else F.lit(0.0),
            "power_diff": step,
            "power_diff_abs": F.abs(step),
            "active_units": F.col(units) if units else F.lit(0),
        }
    )
    return plain(near)


def predictor_labels(df: DataFrame, s: Series, change: str | None = None, compressor: str | None = None, lookahead: int = 10, per_hour: float = 4.0) -> DataFrame:
    """1 where enough state changes follow within the row and the next rows."""
    if change is None and compressor is None:
        return df.withColumn("label", F.lit(0))
    needed = max(1, math.ceil(per_hour * lookahead / 60))
    near = with_neighbours(df, s, back=1, ahead=lookahead - 1)
    if change:
        moved = F.col(change)
    else:
        on = F.col(compressor).cast("int")
        moved = F.coalesce(F.abs(on - F.lag(on).over(s.window)), F.lit(0))
    near = near.withColumn("_moved", moved)
    ahead = F.sum("_moved").over(s.window.rowsBetween(0, lookahead - 1))
    return plain(near.withColumn("label", (ahead >= needed).cast("int"))).drop("_moved")


def impute_features(df: DataFrame, s: Series, cols: Sequence[str], zero_if: Sequence[str] = ("gradient", "change")) -> DataFrame:
    """Missing gradients and changes are 0, the rest the last or else the next known value.

    Rows that stay incomplete are dropped.  Remove neutral rows first.
    """
    zero = [c for c in cols if any(word in c for word in zero_if)]
    carried = [c for c in cols if c not in zero]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    if carried:
        filled = running(
            df, s, last={f"_l_{c}": F.col(c) for c in carried}, upcoming={f"_n_{c}": F.col(c) for c in carried}
        )
        df = plain(filled.withColumns({c: F.coalesce(f"_l_{c}", f"_n_{c}") for c in carried}))
        df = df.drop(*[f"_{k}_{c}" for c in carried for k in "ln"])
    return df.na.drop(subset=list(cols))


def rank_within(df: DataFrame, keys: Sequence[str], order: Column, slice_no: Column, out: str = "rank") -> DataFrame:
    """Exact rank within each key: ``order`` is unique and ``slice_no`` rises with it.

    Works like a row_number per key, but counts per slice, so a key may be of any size.
    """
    base = df.withColumns({ORD: order, SLICE: slice_no})
    return plain(running(base, Series(keys=tuple(keys)), sums={out: F.lit(1).cast("long")}))


def shuffled_rank(df: DataFrame, label: str, identity: Sequence[str], seed: int = 42, out: str = "rank") -> DataFrame:
    """A fixed pseudo-random order of the rows of each class, by the hash of their identity."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    part = F.conv(F.substring(digest, 1, 4), 16, 10).cast("long")
    return rank_within(df, (label,), digest, part, out)


def stratified_split(df: DataFrame, identity: Sequence[str], label: str = "target", train: float = 0.7, seed: int = 42) -> DataFrame:
    """Mark ``train`` of each class as training rows, always the same ones."""
    ranked = shuffled_rank(df, label, identity, seed, "_rank").join(class_sizes(df, label), label)
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_n") * F.lit(train) + 1e-9)).drop("_rank", "_n")


def balance_classes(df: DataFrame, identity: Sequence[str], label: str = "target", seed: int = 42, replacement: bool = True) -> DataFrame:
    """As many rows of every class as the smallest class has.

    With replacement the rows are drawn by number: draw i of a class takes the row of rank
    hash(i) mod class size, so the draws join to the rows on (class, rank).
    """
    ranked = shuffled_rank(df, label, identity, seed, "_rank")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    smallest = sizes.agg(F.min("_n")).scalar()
    if not replacement:
        return ranked.filter(F.col("_rank") <= smallest).drop("_rank")
    block = 4096
    starts = sizes.withColumn("_min", smallest).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_min") - 1, F.lit(block).cast("long")))
    )
    last = F.least(F.col("_min") - 1, F.col("_b") + (block - 1))
    draws = starts.repartition(label, "_b").withColumn("_i", F.explode(F.sequence("_b", last)))
    hit = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_i")), F.col("_n")) + 1
    return draws.select(label, hit.alias("_rank")).join(ranked, [label, "_rank"]).drop("_rank")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))


def time_folds(df: DataFrame, s: Series, label: str, folds: int = 5, out: str = "fold", slice: str = "10 minutes") -> DataFrame:
    """Contiguous folds in time order, each with the same share of every class.

    The order runs over all series at once, so its time slices are shorter than those of a
    single series.
    """
    sizes = class_sizes(df, label)
    at = sliced(df, constant(s, slice))
    order = F.struct(F.col(ORD), *s.keys)
    ranked = running(at.withColumn(ORD, order), Series(keys=(label,)), sums={"_rank": F.lit(1).cast("long")})
    fold = F.floor((F.col("_rank") - 1) * folds / F.col("_n")).cast("int")
    return plain(ranked.join(sizes, label)).withColumn(out, fold).drop("_rank", "_n")
