"""Regions, zones and clusters."""

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import TELEMETRY, W, query, rounded
from catalog.scans import scratch
from catalog.scalars import STAB, stab
from wattloom.functions.scalar import BIN_EDGES
from wattloom.operators import clusters as cl
from wattloom.operators import zones as ops
from wattloom.plans import analysis
from wattloom.sources import sinks

METRICS = f"""metrics AS (SELECT entity_id, ts, us, value, coalesce(stddev_samp(value) OVER w, 0) AS power_std, coalesce(avg(value) OVER w, 1) AS power_mean,
    CASE WHEN abs(value - lag(value) OVER ({W})) > 800 THEN 1 ELSE 0 END AS power_jump FROM telemetry
  WINDOW w AS ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
_BIN = "CASE " + " ".join(f"WHEN value <= {b} THEN '{a}-{b}'" for a, b in zip(BIN_EDGES, BIN_EDGES[1:])) + " END"


def regions_sql(group, having=50):
    return f"""binned AS (SELECT *, {group} AS region FROM metrics), reg0 AS (SELECT entity_id, region, min(value) AS power_min, max(value) AS power_max, avg(value) AS power_avg, avg(power_std) AS avg_std,
      avg(power_jump) * 60 AS jump_rate, count(*) AS sample_count FROM binned WHERE region IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {having}),
    regions AS (SELECT *, 0.8::DOUBLE * greatest(0, 1 - avg_std / 1000) + 0.2::DOUBLE * greatest(0, 1 - jump_rate / 60) AS stability_score FROM reg0),
    named AS (SELECT *, CAST(round_even(power_avg, 0) AS BIGINT) || 'W avg (' || CAST(power_min AS BIGINT) || '-' || CAST(power_max AS BIGINT) || 'W)'
      || CASE WHEN stability_score > 0.75 THEN ' [STABIL]' WHEN stability_score < 0.4 THEN ' [TAKTE]' ELSE '' END AS name FROM regions)"""


SCORING = dict(full_std=1000.0, full_rate=60.0)
COLS = "entity_id, region, name, power_min, power_max, power_avg, sample_count, round(avg_std, 6) AS avg_std, round(jump_rate, 6) AS jump_rate, round(stability_score, 6) AS stability_score"


def metrics(t):
    return ops.stability_metrics(t.telemetry, t.S, jump=800)


def regions(t):
    return ops.regions_by_bins(metrics(t), ["entity_id"], **SCORING)


@query(
    "stability_metrics",
    f"WITH {TELEMETRY}, {METRICS} SELECT entity_id, ts, value, round(power_std, 6) AS power_std, round(power_mean, 6) AS power_mean, power_jump, round(least(1, power_std / 600), 6) AS instability FROM metrics",
)
def _(t):
    df = ops.stability_metrics(t.telemetry, t.S, full=600, jump=800)
    return rounded(df, "power_std", "power_mean", "instability")


@query("regions_by_bins", f"WITH {TELEMETRY}, {METRICS}, {regions_sql(_BIN)} SELECT {COLS} FROM named")
def _(t):
    return rounded(regions(t), "avg_std", "jump_rate", "stability_score")


@query("region_summary", f"WITH {TELEMETRY}, {METRICS}, {regions_sql('CAST(hour(ts) AS INTEGER)', 0)} SELECT {COLS} FROM named")
def _(t):
    df = ops.region_summary(metrics(t).withColumn("region", F.hour("ts")), ["entity_id", "region"], **SCORING)
    return rounded(df, "avg_std", "jump_rate", "stability_score")


MIN_STABLE = """ms AS (SELECT k.entity_id, coalesce(arg_min(power_min, (power_min + power_max) / 2) FILTER (power_max > 300 AND stability_score > 0.6),
    CASE WHEN count(*) FILTER (power_max > 300) > 0 THEN greatest(400.0::DOUBLE, arg_max(power_min, stability_score) FILTER (power_max > 300)) END, 450.0::DOUBLE) AS min_stable_power
  FROM (SELECT DISTINCT entity_id FROM telemetry) k LEFT JOIN regions USING (entity_id) GROUP BY 1)"""


@query("min_stable_power", f"WITH {TELEMETRY}, {METRICS}, {regions_sql(_BIN)}, {MIN_STABLE} SELECT * FROM ms")
def _(t):
    return ops.min_stable_power(regions(t), ["entity_id"], t.telemetry.select("entity_id").distinct())


ADVICE = f"""{MIN_STABLE}, ranges AS (SELECT entity_id, string_agg(CAST(power_min AS BIGINT) || '-' || CAST(power_max AS BIGINT) || 'W', ', ' ORDER BY power_min) FILTER (stability_score > 0.6) AS good,
    arg_max(CAST(power_min AS BIGINT) || '-' || CAST(power_max AS BIGINT) || 'W', stability_score) AS best, max(stability_score) AS top FROM regions GROUP BY 1),
  advice AS (SELECT entity_id, min_stable_power, CASE WHEN min_stable_power <> 0 THEN 'Minimale stabile Last: ' || CAST(round_even(min_stable_power, 0) AS BIGINT) || 'W | ' ELSE '' END
    || CASE WHEN good IS NOT NULL THEN 'Empfohlene Bereiche: ' || good WHEN top > 0.4 THEN 'Empfohlene Bereiche: ' || best ELSE '⚠ Kein stabiler Betriebsbereich gefunden.' END AS recommendation
    FROM ms LEFT JOIN ranges USING (entity_id))"""


@query("recommendation", f"WITH {TELEMETRY}, {METRICS}, {regions_sql(_BIN)}, {ADVICE} SELECT * FROM advice")
def _(t):
    minimum = ops.min_stable_power(regions(t), ["entity_id"], t.telemetry.select("entity_id").distinct())
    return ops.recommendation(regions(t), minimum, ["entity_id"])


@query(
    "analyze_series",
    f"""WITH {TELEMETRY}, {METRICS}, {regions_sql(_BIN)}, {ADVICE}, q AS (SELECT entity_id, count(*) AS n, (max(us) - min(us)) / 3600e6::DOUBLE AS h FROM telemetry GROUP BY 1),
      rc AS (SELECT entity_id, count(*) AS region_count, CAST(sum(sample_count) AS BIGINT) AS region_rows FROM regions GROUP BY 1)
    SELECT entity_id, n >= 2000 AND h >= 24 AS sufficient_data, CASE WHEN n >= 2000 AND h >= 24 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS data_quality_score,
      CASE WHEN n >= 2000 AND h >= 24 THEN min_stable_power END AS min_stable_power, CASE WHEN n < 2000 THEN format('Zu wenige Datenpunkte ({{}}). Benötigt mindestens 2000.', n) ELSE recommendation END AS recommendation,
      CASE WHEN n >= 2000 THEN region_count END AS region_count, CASE WHEN n >= 2000 THEN region_rows END AS region_rows
    FROM q LEFT JOIN advice USING (entity_id) LEFT JOIN rc USING (entity_id)""",
)
def _(t):
    df = analysis.analyze_series(t.telemetry, t.S, min_rows=2000, jump=800, **SCORING)
    total = F.aggregate("regions", F.lit(0).cast("long"), lambda a, r: a + r["sample_count"])
    count = F.when(F.col("regions").isNotNull(), F.size("regions").cast("long"))
    return df.withColumns({"region_count": count, "region_rows": total}).drop("regions")


@query(
    "region_dashboard",
    f"""WITH {TELEMETRY}, {METRICS}, {regions_sql(_BIN)} SELECT entity_id, 'ready' AS status, CAST(power_min AS BIGINT) || '-' || CAST(power_max AS BIGINT) || 'W' AS range,
      CAST(round_even(stability_score * 100, 0) AS INTEGER) AS stability, stability_score > 0.7 AS is_stable FROM named""",
)
def _(t):
    return ops.region_dashboard(regions(t), ["entity_id"])


@query("regions_by_kmeans")
def _(t):
    return analysis.regions_by_kmeans(metrics(t), ["entity_id"], **SCORING)


@query("analyze_series_kmeans")
def _(t):
    return analysis.analyze_series(t.by_user, t.S, method="kmeans", min_rows=20, jump=800, **SCORING).drop("regions")


_TRAIL = f"""tr AS (SELECT entity_id, ts, avg(value) OVER w AS power_mean, stddev_pop(value) OVER w AS power_std, count(*) OVER w AS n FROM telemetry
  WINDOW w AS ({W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)), lab AS (SELECT *, CAST(floor(power_mean / 100) AS INTEGER) AS cluster FROM tr WHERE n = 30)"""
ZONES_SQL = f"""{_TRAIL}, zn AS (SELECT entity_id, CASE WHEN avg(power_std) < 450 THEN 'stable' ELSE 'unstable' END AS kind, CAST(cluster AS BIGINT) AS cluster_id,
      CASE WHEN avg(power_std) < 450 THEN avg(power_mean) END AS power_mean, avg(power_std) AS power_std,
      CASE WHEN avg(power_std) >= 450 THEN quantile_cont(power_mean, 0.1) END AS power_min, CASE WHEN avg(power_std) >= 450 THEN quantile_cont(power_mean, 0.9) END AS power_max,
      count(*) AS samples FROM lab GROUP BY entity_id, cluster HAVING count(*) >= 10)"""


def labelled(t):
    from wattloom.operators.windows import trailing_exclusive

    df = trailing_exclusive(t.telemetry, t.S)
    return df.withColumn("cluster", F.floor(F.col("power_mean") / 100).cast("int"))


def learned(t):
    return ops.zones_from_labels(labelled(t), ["entity_id"], stable_below=450)


_Z = ("power_mean", "power_std", "power_min", "power_max")


@query(
    "zones_from_labels",
    f"WITH {TELEMETRY}, {ZONES_SQL} SELECT entity_id, kind, cluster_id, samples, {', '.join(f'round({c}, 6) AS {c}' for c in _Z)} FROM zn",
)
def _(t):
    return rounded(learned(t), *_Z)


@query(
    "fallback_zones",
    f"""WITH {TELEMETRY}, {ZONES_SQL}, k AS (SELECT entity_id FROM zn GROUP BY 1 HAVING count(*) FILTER (kind = 'stable') >= 3),
      z2 AS (SELECT entity_id, kind, cluster_id, samples, {', '.join(f'round({c}, 6) AS {c}' for c in _Z)} FROM zn WHERE entity_id IN (SELECT entity_id FROM k))
    SELECT * FROM z2 UNION ALL SELECT entity_id, kind, NULL, NULL, m, s, lo, hi FROM (SELECT DISTINCT entity_id FROM telemetry WHERE entity_id NOT IN (SELECT entity_id FROM z2)),
      (VALUES ('unstable', NULL::DOUBLE, NULL::DOUBLE, 1000.0::DOUBLE, 1500.0::DOUBLE), ('stable', 500.0, 50.0, NULL, NULL), ('stable', 1800.0, 80.0, NULL, NULL)) v(kind, m, s, lo, hi)""",
)
def _(t):
    z = learned(t)
    rich = z.filter("kind = 'stable'").groupBy("entity_id").count().filter("count >= 3")
    known = rounded(z.join(rich, "entity_id", "left_semi"), *_Z)
    return ops.fallback_zones(known, t.telemetry, ["entity_id"])


@query("learn_zones")
def _(t):
    # readings are far apart here, so a bucket holds one
    return analysis.learn_zones(t.telemetry, t.S, stable_below=450)


@query("retrain_zones_daily")
def _(t):
    path = scratch(t, "zones")
    for day in (25, 26):
        out = analysis.retrain_zones(t.telemetry, t.S, path, dt.datetime(2024, 1, day, 3, tzinfo=dt.timezone.utc), stable_below=450)
    return out


@query("gmm_bic_select")
def _(t):
    df = stab(t).filter("value > 100 and power_std is not null")
    out, _ = cl.gmm_bic_select(df, ["value", "power_std"], range(2, 8), ["entity_id"])
    return out.select("entity_id", "ts", "value", "power_std", "cluster")


# one round over all rows from fixed starts: components at each key's quantiles, with the key's variances
_SIZES = (2, 3, 5)
_STARTS = f"""pts AS (SELECT entity_id, ts, value AS x, std AS y FROM stab WHERE value > 100 AND std IS NOT NULL),
    start AS ({" UNION ALL ".join(f"""SELECT entity_id, {k} AS k, {j} AS j, 1.0::DOUBLE / {k} AS w, quantile_cont(x, {(j + 0.5) / k!r}::DOUBLE) AS mx, quantile_cont(y, {(j + 0.5) / k!r}::DOUBLE) AS my,
      var_pop(x) AS vx, var_pop(y) AS vy, count(*) AS n FROM pts GROUP BY entity_id""" for k in _SIZES for j in range(k))})"""


def starts(df):
    """(entity_id, k, weights, means, covs) of the fixed starts."""
    from wattloom.operators.stats import quantiles

    names = {f"q{k}_{j}": (j + 0.5) / k for k in _SIZES for j in range(k)}
    at = quantiles(df, ["entity_id"], "value", names).join(quantiles(df, ["entity_id"], "power_std", names).withColumnsRenamed({n: f"s{n}" for n in names}), "entity_id")
    at = at.join(df.groupBy("entity_id").agg(F.var_pop("value").alias("vx"), F.var_pop("power_std").alias("vy")), "entity_id")
    per = [
        F.struct(
            F.lit(k).alias("k"),
            F.array(*[F.lit(1.0 / k)] * k).alias("weights"),
            F.array(*[c for j in range(k) for c in (F.col(f"q{k}_{j}"), F.col(f"sq{k}_{j}"))]).alias("means"),
            F.array(*[c for _ in range(k) for c in (F.col("vx"), F.lit(0.0), F.lit(0.0), F.col("vy"))]).alias("covs"),
        )
        for k in _SIZES
    ]
    return at.select("entity_id", F.inline(F.array(*per)))


def components(df, *columns):
    """One row a component."""
    flat = df.select("entity_id", "k", "score", "bic", F.posexplode("components").alias("component", "c"))
    return flat.select("entity_id", "k", F.col("component").cast("int").alias("component"), *columns)


@query(
    "gmm_round",
    f"""WITH {TELEMETRY}, {STAB}, {_STARTS},
      dens AS (SELECT entity_id, ts, k, j, x, y, n, ln(w) - ln(2 * pi()) - 0.5::DOUBLE * (ln(vx) + ln(vy)) - 0.5::DOUBLE * ((x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy) AS lp
        FROM pts JOIN start USING (entity_id)),
      tops AS (SELECT *, max(lp) OVER (PARTITION BY entity_id, ts, k) AS top FROM dens),
      ll AS (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY entity_id, ts, k)) AS l FROM tops),
      score AS (SELECT entity_id, k, sum(l) / k AS score, any_value(n) AS n FROM ll GROUP BY entity_id, k),
      est AS (SELECT entity_id, k, j, sum(exp(lp - l)) AS s, sum(exp(lp - l) * x) / s AS mx, sum(exp(lp - l) * y) / s AS my, sum(exp(lp - l) * x * x) / s - mx * mx + 1e-6 AS vx,
        sum(exp(lp - l) * x * y) / s - mx * my AS vxy, sum(exp(lp - l) * y * y) / s - my * my + 1e-6 AS vy FROM ll GROUP BY entity_id, k, j)
    SELECT entity_id, k, CAST(row_number() OVER (PARTITION BY entity_id, k ORDER BY mx) - 1 AS INTEGER) AS component, round(s / n, 6) AS weight, round(mx, 4) AS mean_power, round(my, 4) AS mean_std,
      round(vx, 2) AS var_power, round(vxy, 2) AS covariance, round(vy, 2) AS var_std, round(score, 4) AS log_likelihood,
      round(-2 * score + (6 * k - 1) * ln(n), 4) AS bic FROM est JOIN score USING (entity_id, k)""",
)
def _(t):
    from wattloom.operators import models

    df = stab(t).filter("value > 100 and power_std is not null")
    out = models.one_round(df, ["entity_id"], ["value", "power_std"], models.Mixture(), starts(df))
    names = {"weight": (F.col("c.weight"), 6), "mean_power": (F.col("c.mean")[0], 4), "mean_std": (F.col("c.mean")[1], 4)}
    names |= {"var_power": (F.col("c.cov")[0], 2), "covariance": (F.col("c.cov")[1], 2), "var_std": (F.col("c.cov")[3], 2), "log_likelihood": (F.col("score"), 4), "bic": (F.col("bic"), 4)}
    return components(out, *[F.round(c, digits).alias(n) for n, (c, digits) in names.items()])


@query(
    "kmeans_round",
    f"""WITH {TELEMETRY}, {STAB}, {_STARTS},
      near AS (SELECT entity_id, ts, k, x, y, n, vx, vy, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT *, (x - mx) * (x - mx) / vx + (y - my) * (y - my) / vy AS d
        FROM pts JOIN start USING (entity_id)) GROUP BY ALL),
      cost AS (SELECT entity_id, k, sum(d) AS inertia FROM near GROUP BY entity_id, k),
      est AS (SELECT entity_id, k, j, count(*) / any_value(n) AS s, avg(x) AS mx, avg(y) AS my FROM near GROUP BY entity_id, k, j),
      a AS (SELECT entity_id, k, j, coalesce(est.s, 0) AS s, coalesce(est.mx, start.mx) AS mx, coalesce(est.my, start.my) AS my FROM start LEFT JOIN est USING (entity_id, k, j))
    SELECT entity_id, k, CAST(row_number() OVER (PARTITION BY entity_id, k ORDER BY mx, my) - 1 AS INTEGER) AS component, round(s, 6) AS weight,
      round(mx, 4) AS mean_power, round(my, 4) AS mean_std, round(inertia, 4) AS inertia FROM a JOIN cost USING (entity_id, k)""",
)
def _(t):
    from wattloom.operators import models

    df = stab(t).filter("value > 100 and power_std is not null")
    given = starts(df).withColumn("covs", F.array().cast("array<double>"))
    out = models.one_round(df, ["entity_id"], ["value", "power_std"], models.Means(), given)
    return components(
        out, F.round("c.weight", 6).alias("weight"), F.round(F.col("c.mean")[0], 4).alias("mean_power"), F.round(F.col("c.mean")[1], 4).alias("mean_std"), F.round("score", 4).alias("inertia")
    )


@query("gmm_labels")
def _(t):
    from wattloom.operators.stats import with_stability

    df = with_stability(t.telemetry, t.S, 6).withColumnRenamed("value", "power").withColumn("power_std", F.col("power_std") / 4)
    return cl.gmm_labels(df, ["entity_id", "ts"], keys=["entity_id"]).select("entity_id", "ts", "cluster", "label")


# density on the scale of the readings, a cluster needs 50 neighbours
_POINTS = f"""pts AS (SELECT entity_id, ts, value / 512 AS x, std / 256 AS y FROM stab WHERE std IS NOT NULL)"""


def points(t):
    df = stab(t).filter("power_std is not null")
    return df.select("entity_id", "ts", (F.col("value") / 512).alias("x"), (F.col("power_std") / 256).alias("y"))


@query(
    "dbscan_clusters",
    f"""WITH {TELEMETRY}, {STAB}, {_POINTS},
      n AS (SELECT a.entity_id, a.ts, any_value(a.x) AS x, any_value(a.y) AS y, count(*) >= 50 AS is_core FROM pts a JOIN pts b ON b.x BETWEEN a.x - 0.15 AND a.x + 0.15
        AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0225 GROUP BY 1, 2),
      r AS (SELECT DISTINCT a.entity_id, a.ts FROM n a JOIN n b ON b.is_core AND b.x BETWEEN a.x - 0.15 AND a.x + 0.15 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0225)
    SELECT entity_id, ts, is_core, (entity_id, ts) NOT IN (SELECT (entity_id, ts) FROM r) AS is_noise FROM n""",
)
def _(t):
    df = cl.dbscan(points(t), ["x", "y"], eps=0.15, min_samples=50)
    return df.select("entity_id", "ts", "is_core", (F.col("cluster") < 0).alias("is_noise"))


@query("dbscan_cluster_sizes")
def _(t):
    df = cl.dbscan(points(t), ["x", "y"], eps=0.15, min_samples=50)
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_core").alias("core_rows"))


@query("pca_2d")
def _(t):
    from wattloom.operators.features import symptom_features
    from catalog.registry import channels

    df = symptom_features(channels(t), t.SITE, {"eg": ("temp_eg", "target_eg")})
    out, _ = cl.pca_2d(df, ["power", "power_std", "power_spread", "outdoor_temp", "delta_eg", "hour_sin"])
    return out.select("site_id", "ts", "pc1", "pc2")


@query(
    "pca_two_columns",
    f"""WITH {TELEMETRY}, {STAB}, p AS (SELECT entity_id, ts, value AS x, std AS y FROM stab WHERE std IS NOT NULL),
      z AS (SELECT entity_id, ts, (x - avg(x) OVER k) / stddev_pop(x) OVER k AS a, (y - avg(y) OVER k) / stddev_pop(y) OVER k AS b, corr(x, y) OVER k AS r, count(*) OVER k AS n
        FROM p WINDOW k AS (PARTITION BY entity_id))
    SELECT entity_id, ts, round(abs(a + sign(r) * b) / sqrt(2), 6) AS pc1, round(abs(a - sign(r) * b) / sqrt(2), 6) AS pc2, n AS rows, round((1 + abs(r)) / 2, 6) AS share1, round((1 - abs(r)) / 2, 6) AS share2 FROM z""",
)
def _(t):
    out, shares = cl.pca_2d(stab(t).select("entity_id", "ts", "value", "power_std"), ["value", "power_std"], ["entity_id"])
    share = [F.round(F.col("shares")[i], 6).alias(f"share{i + 1}") for i in range(2)]
    return out.join(shares, "entity_id").select("entity_id", "ts", F.round(F.abs("pc1"), 6).alias("pc1"), F.round(F.abs("pc2"), 6).alias("pc2"), "rows", *share)


@query(
    "standardize",
    f"""WITH {TELEMETRY} SELECT entity_id, ts, round((value - avg(value) OVER k) / stddev_pop(value) OVER k, 6) AS value_z,
      round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value_all FROM telemetry WINDOW k AS (PARTITION BY entity_id)""",
)
def _(t):
    df = cl.standardize(t.telemetry, ["value"], ["entity_id"])
    df = cl.standardize(df, ["value"], suffix="_all")
    return rounded(df, "value_z", "value_all").select("entity_id", "ts", "value_z", "value_all")


@query(
    "write_zone_config",
    f"""WITH {TELEMETRY}, {STAB}, c AS (SELECT CAST(floor(value / 500) AS INTEGER) AS cluster, count(*) AS size, median(std) AS m FROM stab GROUP BY 1)
    SELECT 'gmm' AS method, count(*) AS clusters, CAST(sum(size) AS BIGINT) AS rows, count(*) FILTER (m < 400) AS stable_clusters,
      (SELECT round(quantile_cont(std, 0.25), 6) FROM stab WHERE value > 100) AS quantile_threshold FROM c""",
)
def _(t):
    from wattloom.operators.stats import cluster_stats, quantiles

    path = scratch(t, "zone_config")
    df = stab(t).withColumn("cluster", F.floor(F.col("value") / 500).cast("int"))
    cut = quantiles(df.filter("value > 100"), [], "power_std", {"q": 0.25}).scalar()
    config = sinks.zone_config(cluster_stats(df, power="value", outdoor=None), cut, stable_below=400)
    sinks.write_zone_config(config, path)
    back = t.spark.read.schema(config.schema).json(path)
    total = F.aggregate("clusters", F.lit(0).cast("long"), lambda a, c: a + c["size"])
    return back.select(
        "method",
        F.size("clusters").cast("long").alias("clusters"),
        total.alias("rows"),
        F.size("stable_clusters").cast("long").alias("stable_clusters"),
        F.round("quantile_threshold", 6).alias("quantile_threshold"),
    )
