"""Clustering: labels from the models of each key, principal components, and density clusters on a grid."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.operators import models
from wattloom.operators.joins import label_writeback, stable_cluster_label
from wattloom.operators.stats import quantiles
from wattloom.series import ORD, SLICE, Series, running
from wattloom.session import checkpoint_dir, saved


def standardize(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """(x - mean) / population std per key or overall; a constant column becomes 0."""
    aggs = [a for c in cols for a in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))]
    stats = df.groupBy(*keys).agg(*aggs)
    if keys:
        joined = df.join(stats, list(keys))
    else:
        names = [f"_{k}_{c}" for c in cols for k in "ms"]
        joined = df.withColumn("_stats", stats.select(F.struct(*names)).scalar()).select(*df.columns, "_stats.*")
    z = {
        f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
        for c in cols
    }
    return joined.withColumns(z).drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def kmeans_labels(df: DataFrame, cols: Sequence[str], k: int, keys: Sequence[str] = (), seed: int = 42, restarts: int = 10, out: str = "cluster") -> DataFrame:
    """Cluster numbers of each key's cheapest k-means run on standardised columns; of all rows without keys."""
    grouped, names = models.grouped(df, keys)
    fitted = models.k_means(grouped, names, cols, k, restarts, seed=seed)
    return models.label(grouped, names, cols, fitted, out).select(*df.columns, out)


def gmm_bic_select(df: DataFrame, cols: Sequence[str], ks: Sequence[int], keys: Sequence[str] = (), seed: int = 42, restarts: int = 3, scale: bool = True, min_rows: int = 1, out: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Labels of each key's mixture with the smallest BIC, and all candidates with their BIC and status.

    Every number of components is fitted from several starts. Without keys all rows share a model. Rows that lack a
    value, and keys with fewer than ``min_rows`` complete rows, get no label.
    """
    grouped, names = models.grouped(df, keys)
    fitted = models.mixtures(grouped, names, cols, ks, restarts, seed=seed, scale=scale, min_rows=min_rows)
    labelled = models.label(grouped, names, cols, fitted, out).select(*df.columns, out)
    return labelled, fitted.drop(*[k for k in names if k not in keys])


def gmm_labels(df: DataFrame, identity: Sequence[str], power: str = "power", std: str = "power_std", ks: Sequence[int] = range(2, 8), keys: Sequence[str] = (), min_power: float = 100.0, stable_below: float = 80.0, seed: int = 42) -> DataFrame:
    """stable / unstable / unknown from each key's mixture clusters of (power, std) of its running rows."""
    running = df.filter((F.col(power) > min_power) & F.col(std).isNotNull())
    kept = [*identity, *[k for k in keys if k not in identity]]
    labelled, _ = gmm_bic_select(running.select(*kept, power, std), [power, std], ks, keys, seed)
    medians = quantiles(labelled, [*keys, "cluster"], std, {"m": 0.5})
    back = label_writeback(df, labelled, identity)
    return stable_cluster_label(back, medians.filter(F.col("m") < stable_below), keys=keys)


def pca_2d(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """First two principal components of each key's standardised columns, and their shares of the variance.

    Covariances are sums over all rows of a key; only these small matrices are gathered, a key a group. A component's
    largest weight is positive. Rows that lack a value are dropped; a key with no variance has components of 0 and
    null shares. The second frame has (keys, rows, shares) with one row a key.
    """
    grouped, on = models.grouped(df.na.drop(subset=list(cols)), keys)
    data, d = standardize(grouped, cols, on), len(cols)
    pairs = [(i, j) for i in range(d) for j in range(d)]
    sums = [F.avg(F.col(f"{cols[i]}_z") * F.col(f"{cols[j]}_z")) for i, j in pairs]
    facts = data.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.array(*sums).alias("_cov"))

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        e, v = np.linalg.eigh(np.array(table.column("_cov")[0].as_py()).reshape(d, d))
        e, v = e[::-1], v[:, ::-1][:, :2]
        v = v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1, 1)
        total = e.sum()
        shares = [float(x / total) for x in e[:2]] if total > 0 else [None, None]
        columns = {k: pa.array([x.as_py()], table.column(k).type) for k, x in zip(on, key)}
        lists = pa.list_(pa.float64())
        return pa.table(columns | {"rows": table.column("rows").combine_chunks(), "shares": pa.array([shares], lists), "_w": pa.array([v.T.ravel().tolist()], lists)})

    types = ", ".join(f"`{k}` {facts.schema[k].dataType.simpleString()}" for k in on)
    # a row a key, used for the rows and for the shares
    solved = saved(facts.groupBy(*on).applyInArrow(solve, f"{types}, rows long, shares array<double>, _w array<double>"), "components")
    joined = data.join(solved.select(*on, "_w"), on)
    pc = {f"pc{c + 1}": reduce(Column.__add__, [F.col(f"{x}_z") * F.col("_w")[c * d + i] for i, x in enumerate(cols)]) for c in range(min(2, d))}
    return joined.withColumns(pc).select(*df.columns, *pc), solved.select(*keys, "rows", "shares")


# -- density clusters -------------------------------------------------------------------
#
# Points are first counted per distinct coordinate and placed into cells whose diagonal is
# eps, so the points of one cell are all neighbours.  A cell with min_samples points holds
# core points only, and all core points of a cell share a cluster: cells, not points, are
# connected.  Whatever depends on the distance between a point (or a cell) and another cell
# is decided on bounding boxes: boxes wholly within or wholly beyond eps are settled, the
# others are split in four per dimension and looked at again.  Pairs of points never appear.

_SPLIT = 2  # bits per dimension and level


def _box_ids(dims: Sequence[str], level: int) -> list[Column]:
    return [F.floor(F.col(f"q_{d}") * float(1 << (_SPLIT * level))).alias(f"b_{d}") for d in dims]


def _parents(cols: Sequence[str]) -> list[Column]:
    return [F.shiftright(F.col(c), _SPLIT).alias(c) for c in cols]


def _boxes(points: DataFrame, dims: Sequence[str], level: int) -> DataFrame:
    """Bounding boxes of the points of a level, with the number of points."""
    aggs = [a for d in dims for a in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
    return points.select(*_box_ids(dims, level), *dims, "w").groupBy(*[f"b_{d}" for d in dims]).agg(*aggs, F.sum("w").alias("bw"))


def _square_sum(parts: Sequence[Column]) -> Column:
    return reduce(Column.__add__, [p * p for p in parts])


def _gap(dims, lo_a, hi_a, lo_b, hi_b) -> tuple[Column, Column]:
    """Squared smallest and largest distance between two boxes."""
    zero = F.lit(0.0)
    near = [F.greatest(F.col(lo_b + d) - F.col(hi_a + d), F.col(lo_a + d) - F.col(hi_b + d), zero) for d in dims]
    far = [F.greatest(F.col(hi_b + d) - F.col(lo_a + d), F.col(hi_a + d) - F.col(lo_b + d)) for d in dims]
    return _square_sum(near), _square_sum(far)


def _stencil(cells: DataFrame, dims: Sequence[str], prefix: str) -> DataFrame:
    """Each row with every cell its neighbours within eps can lie in, as ``b_*``."""
    reach = math.ceil(math.sqrt(len(dims)))
    for d in dims:
        shift = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))
        cells = cells.withColumn("_o", shift).withColumn(f"b_{d}", F.col(f"{prefix}{d}") + F.col("_o")).drop("_o")
    return cells


def _children(frontier: DataFrame, boxes: DataFrame, dims: Sequence[str], prefix: str, lo: str, hi: str) -> DataFrame:
    """Replace the boxes ``prefix*`` of the frontier by the boxes one level down."""
    kids = boxes.select(
        *[F.shiftright(f"b_{d}", _SPLIT).alias(f"{prefix}{d}") for d in dims],
        *[F.col(f"b_{d}").alias(f"_k_{d}") for d in dims],
        *[F.col(f"lo_{d}").alias(f"{lo}{d}") for d in dims],
        *[F.col(f"hi_{d}").alias(f"{hi}{d}") for d in dims],
        "bw",
    )
    keys = [f"{prefix}{d}" for d in dims]
    drop = [f"{p}{d}" for d in dims for p in (lo, hi)] + ["bw"]
    joined = frontier.drop(*drop).join(kids, keys).drop(*keys)
    return joined.withColumnsRenamed({f"_k_{d}": f"{prefix}{d}" for d in dims})


def _core_flags(points: DataFrame, cells: DataFrame, dims: Sequence[str], eps: float, min_samples: int) -> DataFrame:
    """Points of sparse cells that have min_samples neighbours, themselves included."""
    p, e2 = [f"p_{d}" for d in dims], eps * eps
    sparse = points.filter(~F.col("dense")).select(
        *[F.col(d).alias(f"p_{d}") for d in dims], *[F.col(f"c_{d}") for d in dims], F.col("cw").alias("have")
    )
    same = reduce(Column.__and__, [F.col(f"b_{d}") == F.col(f"c_{d}") for d in dims])
    frontier = _stencil(sparse, dims, "c_").filter(~same).drop(*[f"c_{d}" for d in dims])
    frontier = frontier.join(_boxes(points, dims, 0), [f"b_{d}" for d in dims])
    core, level = None, 0
    near, far = _gap(dims, "p_", "p_", "lo_", "hi_")
    while True:
        judged = frontier.withColumns({"_in": far <= e2, "_open": (near <= e2) & (far > e2)}).checkpoint()
        totals = judged.groupBy(*p).agg(
            (F.max("have") + F.coalesce(F.sum(F.when(F.col("_in"), F.col("bw"))), F.lit(0))).alias("have"),
            F.coalesce(F.sum(F.when(F.col("_open"), F.col("bw"))), F.lit(0)).alias("_maybe"),
        )
        hit = totals.filter(F.col("have") >= min_samples).select(*p)
        core = hit if core is None else core.unionByName(hit)
        undecided = totals.filter((F.col("have") < min_samples) & (F.col("have") + F.col("_maybe") >= min_samples))
        todo = judged.filter("_open").drop("have", "_in", "_open").join(undecided.drop("_maybe"), p).checkpoint()
        if todo.isEmpty():
            return core.withColumnsRenamed({f"p_{d}": d for d in dims})
        level += 1
        frontier = _children(todo, _boxes(points, dims, level), dims, "b_", "lo_", "hi_")


def _linked_cells(core: DataFrame, dims: Sequence[str], eps: float) -> DataFrame:
    """Pairs of cells that hold core points within eps of each other."""
    e2 = eps * eps
    boxes = _boxes(core, dims, 0)
    left = boxes.select(
        *[F.col(f"b_{d}").alias(f"ca_{d}") for d in dims],
        *[F.col(f"b_{d}").alias(f"a_{d}") for d in dims],
        *[F.col(f"{k}_{d}").alias(f"{k}a_{d}") for d in dims for k in ("lo", "hi")],
    )
    later = F.struct(*[F.col(f"b_{d}") for d in dims]) > F.struct(*[F.col(f"ca_{d}") for d in dims])
    frontier = _stencil(left, dims, "ca_").filter(later).join(boxes, [f"b_{d}" for d in dims])
    frontier = frontier.withColumns({f"cb_{d}": F.col(f"b_{d}") for d in dims})
    pair = [f"{k}_{d}" for k in ("ca", "cb") for d in dims]
    near, far = _gap(dims, "loa_", "hia_", "lo_", "hi_")
    links, level = None, 0
    while True:
        judged = frontier.filter(near <= e2).withColumn("_in", far <= e2).checkpoint()
        hit = judged.filter("_in").select(*pair).distinct()
        links = hit if links is None else links.unionByName(hit)
        todo = judged.filter(~F.col("_in")).drop("_in").join(hit, pair, "left_anti").checkpoint()
        if todo.isEmpty():
            return links
        level += 1
        boxes = _boxes(core, dims, level)
        frontier = _children(todo, boxes, dims, "a_", "loa_", "hia_")
        frontier = _children(frontier, boxes, dims, "b_", "lo_", "hi_")


def _components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex each vertex is connected to.

    Every round takes the smallest label among the neighbours and then follows the label's
    own label, so the number of rounds grows with the logarithm of the longest path.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = vertices.select("v", F.col("v").alias("label")).checkpoint()
    while True:
        seen = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("_n"))
        step = labels.join(seen, "v", "left").select("v", F.col("label").alias("_old"), F.least("label", "_n").alias("label"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("_via"))
        new = step.join(jump, "label", "left").select("v", "_old", F.least("label", "_via").alias("label")).checkpoint()
        if new.filter("label <> _old").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _border(points: DataFrame, core: DataFrame, labels: DataFrame, dims: Sequence[str], eps: float) -> DataFrame:
    """Smallest label of a core point within eps, for the other points."""
    e2 = eps * eps
    p = [f"p_{d}" for d in dims]
    other = points.filter(~F.col("core")).select(*[F.col(d).alias(f"p_{d}") for d in dims], *[F.col(f"c_{d}") for d in dims])
    frontier = _stencil(other, dims, "c_").drop(*[f"c_{d}" for d in dims])
    frontier = frontier.join(_boxes(core, dims, 0), [f"b_{d}" for d in dims])
    frontier = frontier.withColumns({f"cb_{d}": F.col(f"b_{d}") for d in dims})
    pair = [*p, *[f"cb_{d}" for d in dims]]
    near, far = _gap(dims, "p_", "p_", "lo_", "hi_")
    hits, level = None, 0
    while True:
        judged = frontier.filter(near <= e2).withColumn("_in", far <= e2).checkpoint()
        hit = judged.filter("_in").select(*pair).distinct()
        hits = hit if hits is None else hits.unionByName(hit)
        todo = judged.filter(~F.col("_in")).drop("_in").join(hit, pair, "left_anti").checkpoint()
        if todo.isEmpty():
            break
        level += 1
        frontier = _children(todo, _boxes(core, dims, level), dims, "b_", "lo_", "hi_")
    vertex = F.struct(*[F.col(f"cb_{d}").alias(d) for d in dims])
    found = hits.withColumn("v", vertex).join(labels, "v").groupBy(*p).agg(F.min("label").alias("label"))
    return found.withColumnsRenamed({f"p_{d}": d for d in dims})


def dbscan(df: DataFrame, dims: Sequence[str], eps: float = 0.5, min_samples: int = 50, out: str = "cluster") -> DataFrame:
    """Density clusters: adds ``is_core`` and the cluster number, -1 for noise.

    A border point near several clusters joins the one whose smallest cell comes first.
    Rows with a missing coordinate are noise.
    """
    checkpoint_dir(df.sparkSession)
    side = eps / math.sqrt(len(dims)) * (1 - 1e-12)
    cell = [f"c_{d}" for d in dims]
    counted = df.na.drop(subset=list(dims)).groupBy(*dims).agg(F.count(F.lit(1)).alias("w"))
    points = counted.withColumns({f"q_{d}": F.col(d) / side for d in dims})
    points = points.withColumns({f"c_{d}": F.floor(f"q_{d}") for d in dims}).checkpoint()
    cells = points.groupBy(*cell).agg(F.sum("w").alias("cw"))
    points = points.join(cells, cell).withColumn("dense", F.col("cw") >= min_samples).checkpoint()

    flagged = _core_flags(points, cells, dims, eps, min_samples).withColumn("_hit", F.lit(True))
    points = points.join(flagged, list(dims), "left").withColumn("core", F.col("dense") | F.coalesce("_hit", F.lit(False)))
    points = points.drop("_hit").checkpoint()
    core = points.filter("core")

    vertex = F.struct(*[F.col(f"c_{d}").alias(d) for d in dims])
    links = _linked_cells(core, dims, eps).select(
        F.struct(*[F.col(f"ca_{d}").alias(d) for d in dims]).alias("a"), F.struct(*[F.col(f"cb_{d}").alias(d) for d in dims]).alias("b")
    )
    labels = _components(core.select(vertex.alias("v")).distinct(), links)
    # numbered by running counts: slices follow the first dimension, and only their counts meet in one place
    found = labels.select("label").distinct().withColumns({"_all": F.lit(0), SLICE: F.col(f"label.{dims[0]}"), ORD: F.col("label")})
    numbers = running(found, Series(keys=("_all",)), sums={out: F.lit(1).cast("long")}).select("label", (F.col(out) - 1).alias(out))
    inner = core.select(*dims, vertex.alias("v")).join(labels, "v").select(*dims, "label", F.lit(True).alias("is_core"))
    outer = _border(points, core, labels, dims, eps).select(*dims, "label", F.lit(False).alias("is_core"))
    labelled = inner.unionByName(outer).join(numbers, "label").drop("label")
    joined = df.join(labelled, list(dims), "left")
    return joined.withColumns({out: F.coalesce(out, F.lit(-1).cast("long")), "is_core": F.coalesce("is_core", F.lit(False))})
