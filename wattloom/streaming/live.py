"""The operators on live readings.

Built-in windows where they suffice, keyed state for the observer, cycles and cooldowns.
Rows are kept in the state of their key until the watermark has passed them and then taken in
time order, so micro-batches may come in any order: only rows behind the watermark are lost, and
results come ``delay`` later. Where every micro-batch is newer than the one before,
``hold=False`` gives results at once; a row that is not newer than the last one processed for
its key is then late and ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from wattloom.operators.joins import in_ranges, unstable_ranges
from wattloom.operators.observer import FIRST, HISTORY
from wattloom.series import Series, micros
from wattloom.sources.sinks import JSON_STAMP


def stream_resample(df: DataFrame, s: Series, bucket: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Mean per bucket, emitted once the watermark has passed it; later rows are dropped."""
    means = df.withWatermark(s.ts, delay).groupBy(*s.keys, F.window(s.ts, bucket)).agg(F.avg(s.value).alias(s.value))
    return means.select(*s.keys, F.col("window.start").alias("bucket"), s.value)


def stream_stability_emergency(
    df: DataFrame,
    s: Series,
    bucket: str = "1 minute",
    width: str = "15 minutes",
    delay: str = "10 minutes",
    max_std: float = 300.0,
    max_range: float = 800.0,
    min_points: int = 5,
) -> DataFrame:
    """Per bucket: did power oscillate over the bucket means of the last ``width``, both ends included.

    A bucket is emitted once the watermark has passed its end.
    """
    means = df.withWatermark(s.ts, delay).groupBy(*s.keys, F.window(s.ts, bucket).alias("_b")).agg(F.avg(s.value).alias("_v"))
    both_ends = f"{micros(width) + micros(bucket)} microseconds"
    sliding = means.groupBy(*s.keys, F.window(F.window_time("_b"), both_ends, bucket).alias("_w")).agg(
        F.max(F.struct(F.col("_b.end").alias("end"), F.col("_b.start").alias("bucket"), "_v")).alias("_newest"),
        F.count("_v").alias("points"),
        F.stddev_samp("_v").alias("power_std"),
        (F.max("_v") - F.min("_v")).alias("power_range"),
    )
    hit = (F.col("points") >= min_points) & ((F.col("power_std") > max_std) | (F.col("power_range") > max_range))
    # a window that ends in a bucket without readings belongs to no bucket
    return sliding.filter(F.col("_newest.end") == F.col("_w.end")).select(
        *s.keys,
        F.col("_newest.bucket").alias("bucket"),
        F.col("_newest._v").alias(s.value),
        "points",
        "power_std",
        "power_range",
        F.coalesce(hit, F.lit(False)).alias("stability_emergency"),
    )


def stream_zone_flag(df: DataFrame, zones: DataFrame, keys: tuple[str, ...], power: str = "value") -> DataFrame:
    """Live power against the learned zones of the key (a static table, one row per key)."""
    joined = df.join(unstable_ranges(zones, keys), list(keys), "left")
    return joined.withColumn("in_unstable", in_ranges(F.col(power), F.col("_zones"))).drop("_zones")


# held readings are packed: a state of Python lists takes many times the memory
_PENDING = "pending_us binary, pending_v binary"
_CHUNK = 100_000  # rows scored, walked through or given out at once


def _due(batches: Iterable[pd.DataFrame], pending: tuple[bytes, bytes], after: int, state: GroupState, hold: bool) -> tuple[np.ndarray, np.ndarray, tuple[bytes, bytes]]:
    """Times and values to process now, in time order, and those to keep until the watermark has passed them."""
    us, v = [np.frombuffer(pending[0], dtype="int64")], [np.frombuffer(pending[1], dtype="float64")]
    for b in batches:
        b = b[["_us", "_v"]] if hold else b.loc[b["_us"] > after, ["_us", "_v"]]
        # copies, so that the batch can go
        us.append(b["_us"].astype("int64").to_numpy(copy=True))
        v.append(b["_v"].astype("float64").to_numpy(copy=True))
    us, v = np.concatenate(us), np.concatenate(v)
    order = np.argsort(us, kind="stable")
    order = order[np.searchsorted(us, after, side="right", sorter=order) :]
    us, v = us[order], v[order]
    now = np.searchsorted(us, state.getCurrentWatermarkMs() * 1000, side="right") if hold else len(us)
    return us[:now], v[:now], (us[now:].tobytes(), v[now:].tobytes())


def _wake(state: GroupState, pending: tuple[bytes, bytes]) -> None:
    """Calls the key again, with or without new rows, once the watermark has passed its first pending row."""
    if pending[0]:
        first = int(np.frombuffer(pending[0], dtype="int64", count=1)[0])
        state.setTimeoutTimestamp(max(first // 1000, state.getCurrentWatermarkMs()) + 1)


def _each(us: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, float]]:
    for i in range(0, len(us), _CHUNK):
        yield from zip(us[i : i + _CHUNK].tolist(), v[i : i + _CHUNK].tolist())


def _timeout(hold: bool) -> str:
    return GroupStateTimeout.EventTimeTimeout if hold else GroupStateTimeout.NoTimeout


def _key_types(df: DataFrame, s: Series) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in s.keys)


def _with_micros(df: DataFrame, s: Series, delay: str, *more: str) -> DataFrame:
    late = df.withWatermark(s.ts, delay)
    return late.select(*s.keys, s.ts, F.col(s.value).cast("double").alias("_v"), F.unix_micros(s.ts).alias("_us"), *more)


def _risks(values: np.ndarray, jump: float) -> np.ndarray:
    """Risk of each value from itself and the up to 19 before it; 0 for the first four, and where one is missing."""
    out = np.zeros(len(values))
    short = [values[: i + 1][None] for i in range(FIRST - 1, min(HISTORY - 1, len(values)))]
    every = np.lib.stride_tricks.sliding_window_view(values, HISTORY) if len(values) >= HISTORY else []
    at = FIRST - 1
    # each step below makes an array of 20 values a row
    for recent in (*short, *(every[i : i + _CHUNK] for i in range(0, len(every), _CHUNK))):
        jumps = (np.abs(np.diff(recent, axis=1)) > jump).sum(axis=1)
        raw = 0.4 * recent.std(axis=1) / 125.0 + 0.4 * np.ptp(recent, axis=1) / 1000.0 + 0.2 * jumps / 10.0
        out[at : at + len(raw)] = np.clip(np.nan_to_num(raw, nan=0.0), 0.0, 1.0)
        at += len(raw)
    return out


def stream_observer(df: DataFrame, s: Series, delay: str = "10 minutes", jump: float = 200.0, cycling: float = 0.6, hold: bool = True) -> DataFrame:
    """The risk of every reading; the state of a key is its last 20 readings, and with ``hold`` those above the watermark."""
    keys = s.keys  # a description with cuts cannot go to the workers

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last, *pending = state.get if state.exists else ([], -(2**62), b"", b"")
        us, v, pending = _due(batches, pending, last, state, hold)
        values = np.concatenate([np.asarray(held, dtype="float64"), v])
        scores, history = _risks(values, jump)[len(held) :], values[-HISTORY:].tolist()
        if len(us) or pending[0]:
            state.update((history, int(us[-1]) if len(us) else last, *pending))
            _wake(state, pending)
        for at in range(0, max(len(us), 1), _CHUNK):
            some = slice(at, at + _CHUNK)
            out = pd.DataFrame({k: [key[i]] * len(us[some]) for i, k in enumerate(keys)})
            out["_us"], out["value"], out["instability_score"] = us[some], v[some], scores[some]
            yield out

    scored = (
        _with_micros(df, s, delay)
        .groupBy(*s.keys)
        .applyInPandasWithState(
            update,
            f"{_key_types(df, s)}, _us long, value double, instability_score double",
            f"history array<double>, last_us long, {_PENDING}",
            "append",
            _timeout(hold),
        )
    )
    return scored.select(
        *s.keys,
        F.timestamp_micros("_us").alias(s.ts),
        F.col("value").alias(s.value),
        "instability_score",
        F.bround("instability_score", 2).alias("cycling_risk"),
        (F.col("instability_score") > cycling).alias("is_cycling"),
    )


def stream_cycles(df: DataFrame, s: Series, on: float = 200.0, off: float = 100.0, delay: str = "10 minutes", hold: bool = True) -> DataFrame:
    """A row per finished cycle, emitted at its off reading.

    State: on/off, whether the cycle counts (a run on from the first reading does not), its
    start, peak, sum and number of readings, the last time seen, and with ``hold`` the readings
    above the watermark.
    """
    if off > on:
        raise ValueError("the off threshold must not exceed the on threshold")
    keys = s.keys

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            is_on, counts, start, peak, total, known, n, last, *pending = state.get
        else:
            is_on, counts, start, peak, total, known, n, last, *pending = False, False, 0, 0.0, 0.0, 0, 0, -(2**62), b"", b""
        fresh = last == -(2**62)
        times, values, pending = _due(batches, pending, last, state, hold)
        done, names = [], [*keys, "_start", "_end", "duration_minutes", "peak_power", "avg_power", "rows"]
        for us, value in _each(times, values):
            present = value == value
            was, is_on = is_on, (value > on or (is_on and not value < off)) if present else is_on
            if is_on and not was:
                counts, start, peak, total, known, n = not fresh, us, float("-inf"), 0.0, 0, 0
            if is_on or was:
                n += 1
                if present:
                    peak, total, known = max(peak, value), total + value, known + 1
            if was and not is_on and counts:
                done.append((*key, start, us, (us - start) / 6e7, peak, total / known, n))
                if len(done) >= _CHUNK:
                    yield pd.DataFrame(done, columns=names)
                    done.clear()
            fresh = False
        if len(times) or pending[0]:
            newest = int(times[-1]) if len(times) else last
            state.update((bool(is_on), bool(counts), start, peak, total, known, n, newest, *pending))
            _wake(state, pending)
        yield pd.DataFrame(done, columns=names)

    found = (
        _with_micros(df, s, delay)
        .groupBy(*s.keys)
        .applyInPandasWithState(
            update,
            f"{_key_types(df, s)}, _start long, _end long, duration_minutes double, peak_power double, avg_power double, rows long",
            f"is_on boolean, counts boolean, start long, peak double, total double, known long, n long, last_us long, {_PENDING}",
            "append",
            _timeout(hold),
        )
    )
    return found.select(
        *s.keys,
        F.timestamp_micros("_start").alias("start"),
        F.timestamp_micros("_end").alias("end"),
        "duration_minutes",
        "peak_power",
        "avg_power",
        "rows",
    )


def stream_cooldown(df: DataFrame, s: Series, minutes: float = 15.0, emergency_minutes: float = 7.0, emergency: str = "is_emergency", delay: str = "10 minutes", hold: bool = True) -> DataFrame:
    """Wanted actions that the cooldown of their key lets through.

    The state is the time of the last action, and with ``hold`` the wanted actions above the watermark;
    event time clears it when it no longer matters.
    """
    longest, keys = int(max(minutes, emergency_minutes) * 60_000), s.keys

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        acted, last, *pending = state.get if state.exists else (-(2**62), -(2**62), b"", b"")
        if state.hasTimedOut and not len(pending[0]):
            state.remove()
            return
        times, urgents, pending = _due(batches, pending, last, state, hold)
        allowed = []
        for us, urgent in _each(times, urgents):
            if us - acted >= (emergency_minutes if urgent else minutes) * 6e7:
                acted = us
                allowed.append((*key, acted, bool(urgent)))
        if len(times) or pending[0]:
            newest = int(times[-1]) if len(times) else last
            state.update((acted, newest, *pending))
            if pending[0]:
                _wake(state, pending)
            else:
                state.setTimeoutTimestamp(max(newest // 1000 + longest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(allowed, columns=[*keys, "_us", "is_emergency"])

    wanted = df.withWatermark(s.ts, delay).select(*s.keys, s.ts, F.unix_micros(s.ts).alias("_us"), F.coalesce(F.col(emergency).cast("boolean"), F.lit(False)).cast("double").alias("_v"))
    passed = wanted.groupBy(*s.keys).applyInPandasWithState(
        update,
        f"{_key_types(df, s)}, _us long, is_emergency boolean",
        f"acted long, last_us long, {_PENDING}",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return passed.select(*s.keys, F.timestamp_micros("_us").alias(s.ts), "is_emergency")


def append_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Write the rows of a stream as Parquet, exactly once."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)


def stream_episode_sink(episodes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append episodes as JSON lines, one folder per micro-batch.

    A batch that is run again replaces its own folder, so no episode appears twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("timestampFormat", JSON_STAMP).json(f"{path}/batch={number}")

    writer = episodes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
