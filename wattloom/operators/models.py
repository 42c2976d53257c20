"""k-means and Gaussian mixtures of every key at once.

A key's model depends on the key's rows alone. All candidates of all keys - every number of components from every
start - take one pass over the rows a round:

* Rows are counted per distinct point, standardised per key and dealt to parts of about ``PART_ROWS`` points, so a key
  of any size, or a point of any count, spreads over many tasks. The parts stay partitioned for all rounds.
* Starts come from a summary of each key: points counted on a grid over its standardised features, at most
  ``cells`` cells a key whatever its size, with exact sums. Candidates are fitted on the cells first, which leaves few
  rounds to do.
* A key of a single part is settled in one task. Otherwise a round gives each part the parameters of its key and returns the sums a new estimate needs, one row a part and
  component; they are added up and turned into new parameters, one group a key. Rounds go on until every candidate of
  every key has settled. A candidate's score belongs to the very parameters that are returned.

Parameters are saved each round: a lost executor repeats one round at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.session import saved

PART_ROWS = 100_000
#: cells reach this many standard deviations from the mean; points beyond join the outermost cells
_REACH = 4.0
_ALL = "_all"

CANDIDATES = "array<struct<k: int, restart: int, weights: array<double>, means: array<double>, covs: array<double>, score: double, done: boolean>>"
COMPONENTS = "array<struct<weight: double, mean: array<double>, cov: array<double>, const: double, prec: array<double>>>"


def gmm_parameters(k: int, d: int) -> int:
    """Free parameters of a mixture of k full-covariance Gaussians in d dimensions."""
    return (k - 1) + k * d + k * d * (d + 1) // 2


# -- estimates from sums ------------------------------------------------------------------


@dataclass(frozen=True)
class Mixture:
    """Full-covariance Gaussians; a candidate settles when the mean log-likelihood gains less than ``tol``."""

    tol: float = 1e-3
    reg: float = 1e-6
    cells: int = 1024

    def log_density(self, x: np.ndarray, c: dict) -> np.ndarray:
        """Log of weight times density of each row and component."""
        d = x.shape[1]
        low = np.linalg.inv(np.linalg.cholesky(c["covs"]))
        y = np.einsum("kij,knj->kni", low, x[None] - c["means"][:, None])
        half = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)
        with np.errstate(divide="ignore"):
            const = np.log(c["weights"]) + half - 0.5 * d * math.log(2 * math.pi)
        return (const[:, None] - 0.5 * (y * y).sum(axis=2)).T

    def expect(self, x: np.ndarray, w: np.ndarray, second: np.ndarray, c: dict) -> np.ndarray:
        """Sums per component: score share, weight, weight x, weight xx'."""
        p = self.log_density(x, c)
        top = p.max(axis=1, keepdims=True)
        r = np.exp(p - top)
        total = r.sum(axis=1, keepdims=True)
        score = (w * (top[:, 0] + np.log(total[:, 0]))).sum()
        r = r / total
        share = r * w[:, None]
        return np.hstack([np.full((len(share.T), 1), score / len(share.T)), share.sum(axis=0)[:, None], share.T @ x, r.T @ second])

    def maximise(self, s: np.ndarray, c: dict, n: float) -> dict:
        d = c["means"].shape[1]
        w = s[:, 1]
        safe = np.maximum(w, 1e-300)[:, None]
        empty = w < 1e-10
        means = np.where(empty[:, None], c["means"], s[:, 2 : 2 + d] / safe)
        covs = (s[:, 2 + d :] / safe).reshape(-1, d, d) - means[:, :, None] * means[:, None, :]
        covs = (covs + covs.transpose(0, 2, 1)) / 2 + np.eye(d) * self.floor(c)
        covs = np.where(empty[:, None, None], c["covs"], covs)
        return c | {"weights": w / w.sum(), "means": means, "covs": covs}

    def floor(self, c: dict) -> np.ndarray:
        # below that, rounding could leave a covariance without a root
        return np.maximum(self.reg * c.get("unit", 1.0), 1e-12)

    def settled(self, score: float, c: dict, new: dict, n: float) -> bool:
        return abs(score - c["score"]) < self.tol * n

    def starts(self, x: np.ndarray, w: np.ndarray, second: np.ndarray, k: int, restart: int, seed: int) -> dict:
        """k groups of equal weight along a direction: the first columns, their sum, then seeded ones."""
        d = x.shape[1]
        if restart < d:
            along = np.eye(d)[restart]
        elif restart == d:
            along = np.ones(d)
        else:
            along = np.random.default_rng(seed + restart).normal(size=d)
        order = np.argsort(x @ along, kind="stable")
        middle = np.cumsum(w[order]) - w[order] / 2
        group = np.minimum((middle / w.sum() * k).astype(int), k - 1)
        share = np.zeros((len(x), k))
        share[order, group] = 1
        s = np.hstack([np.zeros((k, 1)), (share * w[:, None]).sum(axis=0)[:, None], (share * w[:, None]).T @ x, share.T @ second])
        flat = {"means": np.tile((w @ x) / w.sum(), (k, 1)), "covs": np.tile(np.eye(d), (k, 1, 1)), "score": -math.inf}
        return self.maximise(s, flat, w.sum())

    better = staticmethod(lambda a, b: a > b)


@dataclass(frozen=True)
class Means:
    """k-means; a candidate settles when its centres move less than ``tol`` together (squared, standardised)."""

    tol: float = 1e-4
    cells: int = 4096

    def expect(self, x: np.ndarray, w: np.ndarray, second: np.ndarray, c: dict) -> np.ndarray:
        d = ((x[:, None] - c["means"][None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        share = np.zeros_like(d)
        share[np.arange(len(x)), near] = w
        return np.hstack([(share * d).sum(axis=0)[:, None], share.sum(axis=0)[:, None], share.T @ x])

    def maximise(self, s: np.ndarray, c: dict, n: float) -> dict:
        w = s[:, 1][:, None]
        return c | {"weights": s[:, 1] / n, "means": np.where(w > 0, s[:, 2:] / np.maximum(w, 1e-300), c["means"])}

    def settled(self, score: float, c: dict, new: dict, n: float) -> bool:
        return ((new["means"] - c["means"]) ** 2).sum() <= self.tol

    def starts(self, x: np.ndarray, w: np.ndarray, second: np.ndarray, k: int, restart: int, seed: int) -> dict:
        """Cells drawn with probability by weight and squared distance, the same for a key in any table."""
        rng = np.random.default_rng([seed, restart])
        chosen = [rng.choice(len(x), p=w / w.sum())]
        near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            p = w * near
            chosen.append(rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else chosen[0])
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        return {"weights": np.full(k, 1 / k), "means": x[chosen], "covs": np.zeros((k, 0, 0)), "score": math.inf}

    better = staticmethod(lambda a, b: a < b)


def _settle(kind, x: np.ndarray, w: np.ndarray, second: np.ndarray, c: dict, rounds: int) -> dict:
    """Rounds over weighted points that are all here; the score is that of the returned parameters."""
    n = w.sum()
    for i in range(rounds):
        s = kind.expect(x, w, second, c)
        score = float(s[:, 0].sum())
        new = kind.maximise(s, c, n)
        if i == rounds - 1 or kind.settled(score, c, new, n):
            break
        c = new | {"score": score}
    return c | {"score": score, "done": True}


def _packed(c: dict) -> dict:
    out = {i: [float(v) for v in np.ravel(c[i])] for i in ("weights", "means", "covs")}
    return {"k": int(c["k"]), "restart": int(c["restart"]), "score": float(c["score"]), "done": bool(c["done"])} | out


def _unpacked(c: dict, d: int) -> dict:
    covs = np.array(c["covs"])
    return c | {
        "weights": np.array(c["weights"]), "means": np.array(c["means"]).reshape(-1, d), "covs": covs.reshape(-1, d, d) if covs.size else covs.reshape(c["k"], 0, 0),
    }


def _keyed(key: tuple, names: Sequence[str], n: int) -> dict:
    return {name: pa.repeat(v, n) for name, v in zip(names, key)}


def _second(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (w[:, None, None] * x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


_CANDIDATES = pa.list_(pa.struct([
    ("k", pa.int32()), ("restart", pa.int32()), ("weights", pa.list_(pa.float64())), ("means", pa.list_(pa.float64())),
    ("covs", pa.list_(pa.float64())), ("score", pa.float64()), ("done", pa.bool_()),
]))
_COMPONENTS = pa.list_(pa.struct([
    ("weight", pa.float64()), ("mean", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), ("const", pa.float64()), ("prec", pa.list_(pa.float64())),
]))


class Points:
    """The rows of all keys as weighted points: standardised, dealt to parts and kept for all rounds."""

    def __init__(self, df: DataFrame, keys: Sequence[str], cols: Sequence[str], min_rows: int):
        self.keys, self.d = list(keys), len(cols)
        self.x = [f"_x{i}" for i in range(self.d)]
        named = df.select(*keys, *[F.col(c).cast("double").alias(x) for c, x in zip(cols, self.x)]).na.drop(subset=self.x)
        facts = named.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.avg(x) for x in self.x]).alias("mean"),
            F.array(*[F.stddev_pop(x) for x in self.x]).alias("std"),
        )
        scale = F.transform("std", lambda s: F.when(s > 0, s).otherwise(1.0))
        status = F.when(F.col("n") < min_rows, "too_few_rows").otherwise("ok")
        # one row a key, read in every round
        self.facts = saved(facts.withColumns({"std": scale, "status": status, "parts": F.ceil(F.col("n") / PART_ROWS).cast("int")}), "facts")
        ready = self.facts.filter("status = 'ok'").select(*keys, "mean", "std", "parts")
        counted = named.groupBy(*keys, *self.x).agg(F.count(F.lit(1)).cast("double").alias("w")).join(ready, list(keys))
        z = [((F.col(x) - F.col("mean")[i]) / F.col("std")[i]).alias(x) for i, x in enumerate(self.x)]
        part = F.pmod(F.xxhash64(*self.x), F.col("parts").cast("long")).cast("int").alias("part")
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = counted.select(*keys, part, *z, "w").repartition(n, *keys, "part").persist(StorageLevel.MEMORY_AND_DISK)

    def cells(self, most: int) -> DataFrame:
        """Grid cells of each key with their weight and sums; at most ``most`` a key."""
        dims = min(self.d, int(math.log2(most)))
        levels = int(most ** (1 / dims) + 1e-9)
        at = [F.floor((F.greatest(F.lit(-_REACH), F.least(F.lit(_REACH * (1 - 1e-9)), x)) + _REACH) * (levels / (2 * _REACH))).cast("int") for x in self.x[:dims]]
        pairs = [(i, j) for i in range(self.d) for j in range(self.d)]
        return self.rows.groupBy(*self.keys, F.array(*at).alias("cell")).agg(
            F.sum("w").alias("w"),
            F.array(*[F.sum(F.col("w") * F.col(x)) for x in self.x]).alias("s1"),
            F.array(*[F.sum(F.col("w") * F.col(self.x[i]) * F.col(self.x[j])) for i, j in pairs]).alias("s2"),
        )

    @property
    def key_schema(self) -> str:
        return "".join(f"`{k}` {self.facts.schema[k].dataType.simpleString()}, " for k in self.keys)


def _starts(points: Points, kind, ks: Callable[[int], Sequence[int]], restarts: int, seed: int, scale: bool) -> DataFrame:
    keys, d = points.keys, points.d

    def fit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cells = sorted(left.select(["cell", "w", "s1", "s2"]).to_pylist(), key=lambda r: r["cell"])
        w = np.array([r["w"] for r in cells])
        x = np.array([r["s1"] for r in cells]).reshape(-1, d) / w[:, None]
        second = np.array([r["s2"] for r in cells]).reshape(-1, d * d)
        std = np.ones(d) if scale else np.array(right.column("std")[0].as_py())
        n = right.column("n")[0].as_py()
        made = []
        for k, r in ((k, r) for k in ks(n) for r in range(restarts)):
            c = kind.starts(x, w, second, k, r, seed) | {"k": k, "restart": r, "unit": 1 / std**2}
            # the rows have a score of their own
            made.append(_packed(_settle(kind, x, w, second, c, 300) | {"score": c["score"], "done": False}))
        return pa.table(_keyed(key, keys, 1) | {"candidates": pa.array([made], _CANDIDATES)})

    ready = points.facts.filter("status = 'ok'").select(*keys, "n", "std")
    return points.cells(kind.cells).groupBy(*keys).cogroup(ready.groupBy(*keys)).applyInArrow(fit, f"{points.key_schema}candidates {CANDIDATES}")


def _alone(points: Points, params: DataFrame, kind, rounds: int, scale: bool) -> DataFrame:
    """Keys of a single part need no exchange: their rounds follow each other in one task."""
    keys, d, names = points.keys, points.d, points.x

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        given = right.column("candidates")[0].as_py() if len(right) else []
        if given and right.column("parts")[0].as_py() == 1:
            x, w = np.column_stack([left.column(c).to_numpy() for c in names]), left.column("w").to_numpy()
            std = np.ones(d) if scale else np.array(right.column("std")[0].as_py())
            second = _second(x, w)
            given = [_packed(_settle(kind, x, w, second, _unpacked(c, d) | {"unit": 1 / std**2}, rounds)) for c in given]
        made = {"candidates": pa.array([given], _CANDIDATES)} if len(right) else {"candidates": pa.array([], _CANDIDATES)}
        return pa.table(_keyed(key[:-1], keys, len(right)) | made)

    first = params.join(points.facts.select(*keys, "parts", "std"), list(keys)).withColumn("part", F.lit(0))
    # other parts find no parameters and give no row
    rows = points.rows.join(points.facts.filter("parts = 1").select(*keys), list(keys), "left_semi")
    both = rows.groupBy(*keys, "part").cogroup(first.groupBy(*keys, "part"))
    return both.applyInArrow(settle, f"{points.key_schema}candidates {CANDIDATES}")


def _sums(points: Points, params: DataFrame, kind) -> DataFrame:
    """(keys, candidate, component, s): what a new estimate needs, added up over all parts of a key."""
    keys, d, names = points.keys, points.d, points.x
    width = 2 + d + (d * d if isinstance(kind, Mixture) else 0)

    def expect(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        x = np.column_stack([left.column(c).to_numpy() for c in names]) if len(left) else np.empty((0, d))
        w = left.column("w").to_numpy()
        second = _second(x, w) if isinstance(kind, Mixture) else None
        at, of, s = [], [], []
        for i, c in enumerate(right.column("candidates")[0].as_py() if len(right) and len(left) else []):
            if not c["done"]:
                got = kind.expect(x, w, second, _unpacked(c, d))
                at += [i] * len(got)
                of += range(len(got))
                s += got.tolist()
        columns = {"candidate": pa.array(at, pa.int32()), "component": pa.array(of, pa.int32()), "s": pa.array(s, pa.list_(pa.float64()))}
        return pa.table(_keyed(key[:-1], keys, len(at)) | columns)

    parts = params.join(points.facts.select(*keys, "parts"), list(keys))
    dealt = parts.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "candidates")
    each = points.rows.groupBy(*keys, "part").cogroup(dealt.groupBy(*keys, "part"))
    each = each.applyInArrow(expect, f"{points.key_schema}candidate int, component int, s array<double>")
    return each.groupBy(*keys, "candidate", "component").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))


def _round(points: Points, params: DataFrame, kind, last: bool, scale: bool, move: bool = False) -> DataFrame:
    """New parameters with the scores of the old ones; settled candidates stay as they are (all, if ``last``).

    With ``move`` all take the new parameters.
    """
    keys, d = points.keys, points.d

    def estimate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return pa.table(_keyed(key, keys, 0) | {"candidates": pa.array([], _CANDIDATES)})
        given = right.column("candidates")[0].as_py()
        std = np.ones(d) if scale else np.array(right.column("std")[0].as_py())
        n = right.column("n")[0].as_py()
        found: dict[int, list] = {}
        for row in left.select(["candidate", "component", "s"]).to_pylist():
            found.setdefault(row["candidate"], []).append((row["component"], row["s"]))
        out = []
        for i, c in enumerate(given):
            if i in found:
                s = np.array([v for _, v in sorted(found[i])])
                c = _unpacked(c, d) | {"unit": 1 / std**2}
                score = float(s[:, 0].sum())
                new = kind.maximise(s, c, n)
                stay = not move and (last or kind.settled(score, c, new, n))
                c = _packed((c if stay else new) | {"score": score, "done": stay})
            out.append(c)
        return pa.table(_keyed(key, keys, 1) | {"candidates": pa.array([out], _CANDIDATES)})

    old = params.join(points.facts.select(*keys, "n", "std"), list(keys))
    sums = _sums(points, params, kind)
    return sums.groupBy(*keys).cogroup(old.groupBy(*keys)).applyInArrow(estimate, f"{points.key_schema}candidates {CANDIDATES}")


MODEL = f"k int, restart int, score double, bic double, best boolean, components {COMPONENTS}"


def _finished(points: Points, params: DataFrame, kind, scale: bool) -> DataFrame:
    """One row a candidate in the units of the columns, components by rising first mean; one row for a key without."""
    keys, d = points.keys, points.d

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        std, mean, n = (np.array(right.column(c)[0].as_py()) for c in ("std", "mean", "n"))
        rows = []
        for c in left.column("candidates")[0].as_py() if len(left) else []:
            c, score = _unpacked(c, d), c["score"]
            means = c["means"] * std + mean
            order = np.lexsort(means.T[::-1])
            if isinstance(kind, Mixture):
                covs = c["covs"] * std[:, None] * std[None]
                prec = np.linalg.inv(covs)
                with np.errstate(divide="ignore"):
                    const = np.log(c["weights"]) - 0.5 * (d * math.log(2 * math.pi) + np.linalg.slogdet(covs)[1])
                score = score if scale else score - n * np.log(std).sum()
                bic = -2 * score + gmm_parameters(c["k"], d) * math.log(n)
            else:
                covs, const, bic = np.zeros((c["k"], 0)), np.zeros(c["k"]), None
                prec = np.tile(np.diag(1 / std**2), (c["k"], 1, 1))
            parts = [
                {"weight": float(c["weights"][i]), "mean": means[i].tolist(), "cov": np.ravel(covs[i]).tolist(), "const": float(const[i]), "prec": np.ravel(prec[i]).tolist()}
                for i in order
            ]
            rows.append({"k": c["k"], "restart": c["restart"], "score": float(score), "bic": None if bic is None else float(bic), "components": parts})
        if rows:
            rank = "bic" if isinstance(kind, Mixture) else "score"
            best = min(range(len(rows)), key=lambda i: (rows[i][rank], rows[i]["k"], rows[i]["restart"]))
            for i, r in enumerate(rows):
                r["best"] = i == best
        names = [("k", pa.int32()), ("restart", pa.int32()), ("score", pa.float64()), ("bic", pa.float64()), ("best", pa.bool_()), ("components", _COMPONENTS)]
        return pa.table(_keyed(key, keys, len(rows)) | {c: pa.array([r[c] for r in rows], t) for c, t in names})

    facts = points.facts.select(*keys, "n", "mean", "std")
    made = params.groupBy(*keys).cogroup(facts.groupBy(*keys)).applyInArrow(finish, points.key_schema + MODEL)
    return points.facts.select(*keys, "n", "status").join(made, list(keys), "left")


def grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame and its keys; without keys, all rows are one."""
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def fit(df: DataFrame, keys: Sequence[str], cols: Sequence[str], kind, ks: Callable[[int], Sequence[int]], restarts: int, seed: int = 42, min_rows: int = 1, max_rounds: int = 100, scale: bool = True) -> DataFrame:
    """(keys, n, status, k, restart, score, bic, best, components) of every candidate of every key.

    ``score`` is the log-likelihood, or the inertia of k-means in standardised units. Keys with fewer than ``min_rows``
    complete rows have one row, with the status ``too_few_rows`` and no model. Without ``scale`` likelihoods are those of
    the columns as they are; the fit is the same but for the floor of variances.
    """
    points = Points(df, keys, cols, min_rows)
    try:
        params = saved(_alone(points, _starts(points, kind, ks, restarts, seed, scale), kind, max_rounds, scale), "starts")
        i, open_ = 0, F.exists("candidates", lambda c: ~c["done"])
        while not params.filter(open_).isEmpty():
            i += 1
            params = saved(_round(points, params, kind, i == max_rounds, scale), "round")
        return saved(_finished(points, params, kind, scale), "models")
    finally:
        points.rows.unpersist()


def one_round(df: DataFrame, keys: Sequence[str], cols: Sequence[str], kind, starts: DataFrame, scale: bool = False) -> DataFrame:
    """One round over all rows from given starts: (keys, k, weights, means, covs), flat arrays in the columns' units.

    The result has the new components, and the score (and BIC) of the starts.
    """
    points, d = Points(df, keys, cols, 1), len(cols)
    try:
        own = starts.join(points.facts.select(*keys, "mean", "std"), list(keys))
        means = F.transform("means", lambda v, i: (v - F.col("mean")[i % d]) / F.col("std")[i % d])
        covs = F.transform("covs", lambda v, i: v / (F.col("std")[F.floor((i % (d * d)) / d).cast("int")] * F.col("std")[i % d]))
        one = F.struct(
            F.col("k").cast("int").alias("k"), F.lit(0).alias("restart"), "weights", means.alias("means"), covs.alias("covs"), F.lit(0.0).alias("score"), F.lit(False).alias("done")
        )
        params = saved(own.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("candidates")), "starts")
        return saved(_finished(points, _round(points, params, kind, False, scale, move=True), kind, scale), "models")
    finally:
        points.rows.unpersist()


def label(df: DataFrame, keys: Sequence[str], cols: Sequence[str], models: DataFrame, out: str = "cluster") -> DataFrame:
    """Number of each row's most likely (or nearest) component in the key's best model, null without one.

    The model of a key has at most a few components; adaptive joins broadcast small model tables and split hot keys.
    """
    best = models.filter(F.coalesce("best", F.lit(False))).select(*keys, F.col("components").alias("_c"))
    d = len(cols)

    def score(c: Column) -> Column:
        off = [F.col(x).cast("double") - c["mean"][i] for i, x in enumerate(cols)]
        quad = sum((off[i] * off[j] * c["prec"][i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
        return c["const"] - 0.5 * quad

    joined = df.join(best, list(keys), "left").withColumn("_c", F.transform("_c", score))
    known = F.col("_c").isNotNull()
    for x in cols:
        known = known & F.col(x).isNotNull()
    number = (F.array_position("_c", F.array_max("_c")) - 1).cast("int")
    return joined.withColumn(out, F.when(known, number)).drop("_c")


def mixtures(df: DataFrame, keys: Sequence[str], cols: Sequence[str], ks: Sequence[int], restarts: int = 3, **options) -> DataFrame:
    """Candidates of Gaussian mixtures; the best of a key has the smallest BIC."""
    sizes = tuple(ks)
    return fit(df, keys, cols, Mixture(), lambda n: sizes, restarts, **options)


def k_means(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: Callable[[int], int] | int, restarts: int = 10, **options) -> DataFrame:
    """Candidates of k-means on standardised columns; the best of a key has the smallest inertia."""
    size = k if callable(k) else (lambda n: k)
    return fit(df, keys, cols, Means(), lambda n: [size(n)], restarts, **options)
