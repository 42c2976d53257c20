"""Window operators."""

from pyspark.sql import functions as F

from catalog.registry import BY_USER, TELEMETRY, W, query, r6, rounded
from wattloom.functions.scalar import phase
from wattloom.operators import windows as ops

STD6 = f"stddev_samp(value) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
PHASED = f"""phased AS (
  SELECT entity_id, ts, us, value, std, CASE WHEN std < 250 THEN 'stable' WHEN std > 500 THEN 'unstable' ELSE 'neutral' END AS phase
  FROM (SELECT *, {STD6} AS std FROM telemetry))"""


def phased(t):
    df = ops.rolling_rows(t.telemetry, t.S, 6, "power", ("std",))
    return df.withColumn("phase", phase("power_std", 250, 500))


@query(
    "lag_phase",
    f"WITH {TELEMETRY}, {PHASED} SELECT entity_id, ts, phase, lag(phase) OVER ({W}) AS prev_phase FROM phased",
)
def _(t):
    return ops.lag_phase(phased(t), t.S, "phase").select("entity_id", "ts", "phase", "prev_phase")


@query(
    "diff_n",
    f"""WITH {BY_USER} SELECT entity_id, ts, coalesce(value - lag(value) OVER ({W}), 0) AS diff1,
      value - lag(value, 6) OVER ({W}) AS diff6 FROM telemetry""",
)
def _(t):
    one = ops.diff_n(t.by_user, t.S, 1, "diff1", fill=0)
    return ops.diff_n(one, t.S, 6, "diff6").select("entity_id", "ts", "diff1", "diff6")


@query(
    "rolling_rows",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, round(avg(value) OVER w, 6) AS roll_mean,
      round(stddev_samp(value) OVER w, 6) AS roll_std, min(value) OVER w AS roll_min, max(value) OVER w AS roll_max
    FROM telemetry WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    return rounded(ops.rolling_rows(t.telemetry, t.S, 10), "roll_mean", "roll_std").drop("value")


@query(
    "power_spread",
    f"""WITH {BY_USER} SELECT entity_id, ts, max(value) OVER w - min(value) OVER w AS spread
    FROM telemetry WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    return ops.power_spread(t.by_user, t.S, 10).drop("value")


@query(
    "power_gradient",
    f"""WITH {TELEMETRY}, d AS (SELECT *, value - lag(value) OVER ({W}) AS d FROM telemetry)
    SELECT entity_id, ts, CASE WHEN count(d) OVER w = 6 THEN round(avg(d) OVER w, 6) END AS gradient,
      CASE WHEN count(d) OVER w = 6 THEN round(abs(avg(d) OVER w), 6) END AS gradient_abs
    FROM d WINDOW w AS ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    df = ops.power_gradient(t.telemetry, t.S)
    return df.select("entity_id", "ts", r6("gradient").alias("gradient"), r6(F.abs("gradient")).alias("gradient_abs"))


@query(
    "rolling_time",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, round(avg(value) OVER w, 6) AS roll_mean,
      round(stddev_samp(value) OVER w, 6) AS roll_std, min(value) OVER w AS roll_min, max(value) OVER w AS roll_max
    FROM telemetry WINDOW w AS ({W} RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)""",
)
def _(t):
    return rounded(ops.rolling_time(t.telemetry, t.S, "2 hours"), "roll_mean", "roll_std").drop("value")


@query(
    "direction_changes",
    f"""WITH {TELEMETRY}, g AS (SELECT *, CAST(sign(coalesce(value - lag(value) OVER ({W}), 0)) AS DOUBLE) AS sign FROM telemetry)
    SELECT entity_id, ts, sign, CASE WHEN sign <> lag(sign) OVER ({W}) THEN 1 ELSE 0 END AS turn FROM g""",
)
def _(t):
    return ops.direction_changes(t.telemetry, t.S).drop("value")


@query(
    "forward_window",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, sum(value) OVER ({W} ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead_sum
    FROM telemetry""",
)
def _(t):
    return ops.forward_window(t.telemetry, t.S).drop("value")


@query(
    "trailing_exclusive",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, power_mean, power_std FROM (
      SELECT entity_id, ts, round(avg(value) OVER w, 6) AS power_mean, round(stddev_pop(value) OVER w, 6) AS power_std,
        count(*) OVER w AS n FROM telemetry WINDOW w AS ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE n = 30""",
)
def _(t):
    return rounded(ops.trailing_exclusive(t.telemetry, t.S), "power_mean", "power_std").drop("value")


@query(
    "islands",
    f"""WITH {TELEMETRY}, {PHASED}, c AS (
      SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER ({W}) THEN 1 ELSE 0 END AS n FROM phased)
    SELECT entity_id, ts, phase, CAST(sum(n) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c""",
)
def _(t):
    return ops.islands(phased(t), t.S, "phase").select("entity_id", "ts", "phase", "run_id")


@query(
    "run_counter",
    f"""WITH {TELEMETRY}, o AS (SELECT *, CASE WHEN value > 300 THEN 1 ELSE 0 END AS on_,
        sum(CASE WHEN value > 300 THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS g FROM telemetry)
    SELECT entity_id, ts, CAST(sum(on_) OVER (PARTITION BY entity_id, g ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS runtime
    FROM o""",
)
def _(t):
    df = t.telemetry.withColumn("on", F.col("value") > 300)
    return ops.run_counter(df, t.S, "on").select("entity_id", "ts", "runtime")


_GAPPY = f"""g AS (SELECT entity_id, ts, us, CASE WHEN value > 300 THEN value END AS known FROM telemetry)"""


@query(
    "ffill",
    f"WITH {TELEMETRY}, {_GAPPY} SELECT entity_id, ts, last_value(known IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS known FROM g",
)
def _(t):
    df = t.telemetry.select("entity_id", "ts", F.expr("case when value > 300 then value end").alias("known"))
    return ops.ffill(df, t.S, ["known"])


@query(
    "bfill",
    f"""WITH {TELEMETRY}, {_GAPPY} SELECT entity_id, ts,
      first_value(known IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS known FROM g""",
)
def _(t):
    df = t.telemetry.select("entity_id", "ts", F.expr("case when value > 300 then value end").alias("known"))
    return ops.bfill(df, t.S, ["known"])


@query(
    "rank_topk",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, value, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY value DESC, us) AS rank FROM telemetry) WHERE rank <= 10""",
)
def _(t):
    return ops.rank_topk(t.telemetry, [F.desc("value"), F.asc("ts")], 10, ("entity_id",))


@query(
    "sample_every_nth",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, value FROM (
      SELECT *, row_number() OVER ({W}) - 1 AS i FROM telemetry) WHERE i >= 10 AND (i - 10) % 5 = 0""",
)
def _(t):
    return ops.sample_every_nth(t.telemetry, t.S, 5, start=10)
