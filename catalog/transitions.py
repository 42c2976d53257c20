"""Phase transitions, their impact, and long stable runs."""

from pyspark.sql import functions as F

from catalog.registry import CHANNEL_COLS, CHANNELS, TELEMETRY, channels, query, rounded
from catalog.joins import _EVENTS
from catalog.window_ops import PHASED
from wattloom.operators import transitions as ops

TH = dict(stable=250, unstable=500)


@query(
    "phase_transitions",
    f"""WITH {TELEMETRY}, {PHASED}, {_EVENTS}
    SELECT entity_id, ts, value, round(std, 6) AS power_std, CASE WHEN prev = 'stable' THEN 'to_unstable' ELSE 'to_stable' END AS transition
    FROM ev WHERE (prev = 'stable' AND phase = 'unstable') OR (prev = 'unstable' AND phase = 'stable')""",
)
def _(t):
    return rounded(ops.phase_transitions(t.telemetry, t.S, **TH), "power_std")


@query(
    "transition_counts",
    f"""WITH {TELEMETRY}, {PHASED}, {_EVENTS} SELECT entity_id, count(*) FILTER (prev = 'stable' AND phase = 'unstable') AS to_unstable,
      count(*) FILTER (prev = 'unstable' AND phase = 'stable') AS to_stable FROM ev GROUP BY 1""",
)
def _(t):
    from wattloom.series import plain

    return plain(ops.with_phases(t.telemetry, t.S, **TH)).groupBy("entity_id").agg(
        F.count_if(F.col("transition") == "to_unstable").alias("to_unstable"),
        F.count_if(F.col("transition") == "to_stable").alias("to_stable"),
    )


_SITE_W = "PARTITION BY site_id ORDER BY us"
_SITE_PH = f"""ph AS (SELECT *, CASE WHEN std < 250 THEN 'stable' WHEN std > 300 THEN 'unstable' ELSE 'neutral' END AS phase FROM (
    SELECT *, stddev_samp(power) OVER ({_SITE_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS std FROM channels)),
  ev AS (SELECT *, lag(phase) OVER ({_SITE_W}) AS prev FROM ph)"""


def _around(c):
    before, after = f"avg(p.{c}) FILTER (p.us <= e.us)", f"avg(p.{c}) FILTER (p.us >= e.us)"
    return f"{before} AS {c}_before, {after} AS {c}_after, {after} - {before} AS {c}_delta"


IMPACT = f"""{CHANNELS}, {_SITE_PH}, impact AS (
  SELECT e.site_id, e.ts, {', '.join(_around(c) for c in CHANNEL_COLS)} FROM ev e
  JOIN channels p ON p.site_id = e.site_id AND p.us BETWEEN e.us - 86400000000 AND e.us + 86400000000
  WHERE e.prev = 'stable' AND e.phase = 'unstable' GROUP BY 1, 2)"""
_ALL = [f"{c}_{k}" for c in CHANNEL_COLS for k in ("before", "after", "delta")]


def impact(t):
    return ops.transition_impact(channels(t), t.SITE, CHANNEL_COLS, "24 hours", stable=250, unstable=300)


@query("transition_impact", f"WITH {IMPACT} SELECT site_id, ts, {', '.join(f'round({c}, 6) AS {c}' for c in _ALL)} FROM impact")
def _(t):
    return rounded(impact(t), *_ALL)


@query(
    "impact_ranking",
    f"WITH {IMPACT}, r AS ("
    + " UNION ALL ".join(f"SELECT '{c}_delta' AS feature, corr(power_delta, {c}_delta) AS r FROM impact" for c in CHANNEL_COLS[1:])
    + """) SELECT feature, round(r, 6) AS r, CASE WHEN r > 0.3 THEN 'up' WHEN r < -0.3 THEN 'down' ELSE '' END AS strength
    FROM r WHERE r IS NOT NULL AND NOT isnan(r)""",
)
def _(t):
    return rounded(ops.impact_ranking(impact(t), CHANNEL_COLS), "r")


RUNS = f"""{PHASED}, g AS (SELECT *, sum(CASE WHEN phase = 'stable' THEN 0 ELSE 1 END) OVER (PARTITION BY entity_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g FROM phased),
  runs AS (SELECT entity_id, min(ts) AS start, max(ts) AS "end", count(*) AS rows, round(avg(value), 6) AS power_mean, round(avg(std), 6) AS power_std, count(*) * 22 AS duration_minutes
    FROM g WHERE phase = 'stable' GROUP BY entity_id, g HAVING count(*) >= 4)"""


def runs(t):
    return rounded(ops.long_stable_runs(t.telemetry, t.S, min_rows=4, minutes_per_row=22, **TH), "power_mean", "power_std")


@query("long_stable_runs", f"WITH {TELEMETRY}, {RUNS} SELECT * FROM runs")
def _(t):
    return runs(t)


@query(
    "stable_run_summary",
    f"""WITH {TELEMETRY}, {RUNS} SELECT entity_id, count(*) AS runs, round(avg(power_mean), 4) AS avg_power, round(avg(power_std), 4) AS avg_std,
      avg(duration_minutes) AS avg_minutes, max(duration_minutes) AS max_minutes, min(duration_minutes) AS min_minutes FROM runs GROUP BY 1""",
)
def _(t):
    return rounded(ops.stable_run_summary(runs(t), ("entity_id",)), "avg_power", "avg_std", digits=4)
