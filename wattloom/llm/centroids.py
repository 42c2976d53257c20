"""k-means over integer vectors with exact, bounded search.

Each vector remembers its nearest and second-nearest centroid, an upper bound of the distance to the first and a
lower bound of the distance to every other. While the upper bound is below the lower one, or below half the way to
the first's nearest neighbour, nothing is computed. Otherwise the search starts from the closer of the two remembered
centroids and goes through that centroid's neighbours, nearest first, until they lie outside the ball that can still
hold one of the two nearest; the ball shrinks with every closer centroid found. What remains is compared by squared
distances in integers, so results and ties are exact. Bounds are rounded outwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import written
from wattloom.llm.vectors import decimals, finite, matrix, scaled, sums

_OUT, _IN = 1 + 1e-12, 1 - 1e-12
STATE = "id {id}, x array<long>, cluster int, second int, upper double, lower double"


def _fits(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squared distances fit into 64 bits."""
    top = max([1, *(abs(int(v)) for a in (x, c) if a.size for v in (a.max(), a.min()))])
    return 4 * top * top * max(1, x.shape[-1]) < 1 << 62


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    diff = x - c
    return (diff * diff).sum(axis=-1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Centroids:
    """Centroids with their distances, nearest neighbours first; k of them, so at most k^2 numbers."""

    def __init__(self, c: np.ndarray, moved: np.ndarray | None = None):
        self.c, self.k = c, len(c)
        wide = c if _fits(c, c) else c.astype(object)
        between = np.stack([_root(_squared(wide, x)) for x in wide]) if self.k else np.empty((0, 0))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.order = np.stack([o[o != i] for i, o in enumerate(self.order)]) if self.k else self.order
        self.between = between
        self.half = np.array([between[i, self.order[i, 0]] / 2 * _IN if self.k > 1 else np.inf for i in range(self.k)])
        self.moved = np.zeros(self.k) if moved is None else moved
        # how far any other centroid has moved
        far = np.argsort(-self.moved, kind="stable")[:2]
        self.others = np.full(self.k, self.moved[far[0]] if self.k else 0.0)
        if self.k:
            self.others[far[0]] = self.moved[far[1]] if self.k > 1 else 0.0


def search(x: np.ndarray, c: Centroids, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
    """New (first, second, upper, lower, number of exact distances) after the centroids have moved."""
    first, second = first.copy(), second.copy()
    upper, lower = (upper + c.moved[first]) * _OUT, (lower - c.others[first]) * _IN
    if c.k < 2:
        return first, second, upper, lower, 0
    wide = x if _fits(x, c.c) else x.astype(object)
    cents = c.c if wide.dtype != object else c.c.astype(object)
    rows = np.flatnonzero(~(upper < np.maximum(lower, c.half[first])))
    near, count = _squared(wide[rows], cents[first[rows]]), len(rows)
    upper[rows] = _root(near) * _OUT
    open_ = ~(upper[rows] < np.maximum(lower[rows], c.half[first[rows]]))
    rows, near = rows[open_], near[open_]
    if not len(rows):
        return first, second, upper, lower, count
    wide, a, b = wide[rows], first[rows], second[rows]
    next_ = _squared(wide, cents[b])
    count += len(rows)
    swap = (next_ < near) | ((next_ == near) & (b < a))
    a[swap], b[swap] = b[swap], a[swap]
    near[swap], next_[swap] = next_[swap], near[swap]
    start, given, origin = a.copy(), b.copy(), _root(near)
    for s in np.unique(start):
        at = np.flatnonzero(start == s)
        for j in c.order[s]:
            # a centroid closer than the second lies within the sum of both distances around the start
            at = at[c.between[s, j] * _IN <= (origin[at] + _root(next_[at])) * _OUT]
            if not len(at):
                break
            todo = at[given[at] != j]
            d = _squared(wide[todo], cents[j])
            count += len(todo)
            nearer = (d < near[todo]) | ((d == near[todo]) & (j < a[todo]))
            one, two = todo[nearer], todo[~nearer]
            b[one], next_[one] = a[one], near[one]
            a[one], near[one] = j, d[nearer]
            middle = (d[~nearer] < next_[two]) | ((d[~nearer] == next_[two]) & (j < b[two]))
            b[two[middle]], next_[two[middle]] = j, d[~nearer][middle]
    first[rows], second[rows] = a, b
    upper[rows], lower[rows] = _root(near) * _OUT, _root(next_) * _IN
    return first, second, upper, lower, count


def distances(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Exact squared distances to the given centroids."""
    if not _fits(x, c):
        x, c = x.astype(object), c.astype(object)
    return _squared(x, c[cluster])


def start_rows(kept: DataFrame, k: int, salt: str = "1:") -> DataFrame:
    """The k rows with an id whose salted SHA-256 is smallest, in that order; equal ids in the order of their vectors."""
    known = kept.where(F.col("id").isNotNull()).withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    return known.orderBy("_h", "x").limit(k).select("x")


def _assigned(state: DataFrame, c: Centroids, width: int, id_type: str) -> DataFrame:
    """One pass of the search over all vectors; ``state`` has the columns of the pass before, or only id and x."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = matrix(batch.column("x"), width), len(batch)
            if "cluster" in batch.schema.names:
                first, second = (batch.column(i).to_numpy().astype(np.int64) for i in ("cluster", "second"))
                upper, lower = (batch.column(i).to_numpy() for i in ("upper", "lower"))
            else:
                first, second = np.zeros(n, dtype=np.int64), np.full(n, min(1, c.k - 1), dtype=np.int64)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            first, second, upper, lower, _ = search(x, c, first, second, upper, lower)
            columns = [batch.column("id"), batch.column("x"), pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "cluster", "second", "upper", "lower"])

    return state.mapInArrow(assign, STATE.format(id=id_type))


def _measured(state: DataFrame, c: np.ndarray, width: int, id_type: str) -> DataFrame:
    """(id, cluster, distance) of the last assignment."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("x"), width), c, batch.column("cluster").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), decimals(d)], ["id", "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(measure, f"id {id_type}, cluster int, distance decimal(38,0)")


def cluster(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    width: int = 64,
    scale: float = 64.0,
    k: int = 16,
    rounds: int = 3,
    salt: str = "1:",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of each vector; ``centroid`` has integers.

    Components are ``floor(scale * c)``, held at 2^53. Each round assigns all vectors and moves every centroid to the
    floor of its vectors' mean; then vectors are assigned once more. Distances are squared and exact, as decimals.

    Rows whose vector is null, of another length than ``width`` or holds a null or non-finite entry are dropped. Rows
    without an id, and repeated rows, are clustered like others; only rows with an id can be starts, repeated ones can
    be several. With fewer than k such rows there are fewer centroids, and without one there is no result row. Ties go
    to the smaller cluster number. Other columns are ignored. A state table is written each round, so a lost executor
    repeats tasks of one round; the driver holds k centroids and their sums.
    """
    good = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where((F.size("v") == width) & finite("v"))
    state = written(good.select("id", scaled("v", scale).alias("x")), "kept")
    id_type = state.schema["id"].dataType.simpleString()
    starts = [r["x"] for r in start_rows(state, k, salt).collect()]
    if not starts:
        return df.sparkSession.createDataFrame([], f"{vec_id} {id_type}, cluster int, distance decimal(38,0), cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    c = Centroids(np.array(starts, dtype=np.int64))
    for _ in range(rounds):
        state = written(_assigned(state, c, width, id_type), "state")
        moved = c.c.copy()
        for g in sums(state, "x", width, "cluster").collect():
            moved[g["g"]] = [int(s) // g["n"] for s in g["sums"]]
        wide = (moved, c.c) if _fits(moved, c.c) else (moved.astype(object), c.c.astype(object))
        c = Centroids(moved, _root(_squared(*wide)) * _OUT)
    state = written(_measured(_assigned(state, c, width, id_type), c.c, width, id_type), "assigned")

    each = state.groupBy("cluster").agg(F.sum("distance").cast("decimal(38,0)").alias("cluster_inertia"))
    total = each.agg(F.sum("cluster_inertia").cast("decimal(38,0)")).first()[0]
    found = {r["cluster"]: r["cluster_inertia"] for r in each.collect()}
    rows = [(i, found.get(i), total, [int(v) for v in x]) for i, x in enumerate(c.c)]
    facts = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<long>")
    # one row a centroid
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
