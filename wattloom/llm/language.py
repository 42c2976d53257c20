"""Language identification by mixtures: each document's language proportions, by expectation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
UNKNOWN = "und"
_CHUNK = 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(text: str) -> np.ndarray:
    """Bucket of each run of three characters in ``_word_``, around a letter, in lower case."""
    out, spill = [], ""
    for i in range(0, len(text), _CHUNK):
        # two characters of the part before complete the runs across the seam
        part = spill + text[i : i + _CHUNK].lower()
        spill = part[-2:]
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        letter = _letters()[code]
        code = np.where(letter, code, np.uint64(32))
        if i == 0:
            code, letter = np.concatenate(([np.uint64(32)], code)), np.concatenate(([False], letter))
        if i + _CHUNK >= len(text):
            code, letter = np.concatenate((code, [np.uint64(32)])), np.concatenate((letter, [False]))
        h = code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + code[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(48))[letter[1:-1]].astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text, and how often each occurs."""
    g = _grams(text)
    if len(g) < 20_000:
        return np.unique(g, return_counts=True)
    n = np.bincount(g, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each gram bucket in each, as an array buckets x languages.

    Counts cover every row with a text and a language. A task sends one row for each language and bucket it
    met; they are summed by Spark. The model has ``BUCKETS`` float32 a language - 256 KB - and more than
    ``max_languages`` languages are an error, which bounds what is collected and broadcast.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in rows:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = _counts(t)
                if name not in found:
                    found[name] = np.zeros(BUCKETS, dtype=np.int64)
                found[name][at] += n
        for name, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r.lang for r in rows.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    found = table.toArrow()
    counts = np.zeros((BUCKETS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    column = np.array([place[x] for x in found["lang"].to_pylist()], dtype=np.int64)
    counts[found["bucket"].to_numpy(), column] = found["n"].to_numpy()
    p = (counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS)
    return names, p.astype(np.float32)


def mixture(p: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Proportions that maximise the likelihood of one document's grams, and its logarithm."""
    w, total = start, counts.sum()
    for _ in range(rounds):
        new = w * ((counts / (p @ w)) @ p) / total
        done = np.abs(new - w).max() < 1e-4
        w = new
        if done:
            break
    return w, float(counts @ np.log(p @ w))


def select_languages(p: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions over the language set of the best penalised likelihood, by backward elimination.

    A set of k languages costs ``penalty * (k - 1) * log(n)``, n the number of grams. From the mixture of all,
    the smallest share leaves as long as the penalised likelihood does not fall.
    """
    p, counts = p.astype(np.float64), counts.astype(np.float64)
    cost = penalty * np.log(counts.sum() + 1)
    kept = np.arange(p.shape[1])
    w, ll = mixture(p, counts, np.full(len(kept), 1 / len(kept)))
    while len(kept) > 1:
        rest = np.delete(np.arange(len(kept)), int(w.argmin()))
        w2, ll2 = mixture(p[:, kept[rest]], counts, w[rest] / w[rest].sum() * 0.9 + 0.1 / len(rest))
        if ll2 + cost < ll:
            break
        kept, w, ll = kept[rest], w2, ll2
    out = np.zeros(p.shape[1])
    out[kept] = w
    return out


def _infer(found: list[tuple[np.ndarray, np.ndarray]], model: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of several documents, none empty.

    All documents are iterated together. For any proportions w, no mixture is more than max(gradient) - n
    better than w, so a document is settled as soon as that shows that no larger set can beat its best single
    language after the penalty. What does not settle goes through :func:`select_languages`.
    """
    width = model.shape[1]
    out = np.zeros((len(found), width))
    if width == 1:
        return out + 1
    sizes = np.array([len(at) for at, _ in found])
    p = model[np.concatenate([at for at, _ in found])]
    c = np.concatenate([n for _, n in found]).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    total = np.add.reduceat(c, starts, dtype=np.float64)
    single = np.add.reduceat(np.log(p) * c[:, None], starts, axis=0, dtype=np.float64)
    best, best_ll = single.argmax(axis=1), single.max(axis=1)
    cost = penalty * np.log(total + 1)
    w = np.full((len(found), width), 0.1 / (width - 1), dtype=np.float32)
    w[np.arange(len(found)), best] = 0.9
    alive = np.arange(len(found))
    for i in range(24):
        mixed = np.einsum("ij,ij->i", p, np.repeat(w, sizes, axis=0))
        gradient = np.add.reduceat(p * (c / mixed)[:, None], starts, axis=0, dtype=np.float64)
        if i % 4 == 3:
            ll = np.add.reduceat(c * np.log(mixed), starts, dtype=np.float64)
            open_ = ll + gradient.max(axis=1) - total - cost >= best_ll
            out[alive[~open_], best[~open_]] = 1
            rows = np.repeat(open_, sizes)
            p, c, alive, sizes = p[rows], c[rows], alive[open_], sizes[open_]
            total, best, best_ll, cost, gradient, w = (x[open_] for x in (total, best, best_ll, cost, gradient, w))
            if not len(alive):
                return out
            starts = np.cumsum(sizes) - sizes
        w = (w * gradient / total[:, None]).astype(np.float32)
    for k, s, n in zip(alive, starts, sizes):
        out[k] = select_languages(p[s : s + n], c[s : s + n], penalty)
    return out


def held_out(doc_id: str, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the part kept for tests; rows without an id don't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 3.0, carry: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """The columns ``carry`` with lang_pred, score and proportions (of each selected language) of every row.

    lang_pred is the language with the largest share and score that share, of the language set with the best
    penalised likelihood (equal shares: the first by name). A null text, one without a letter, or a model without
    languages gives ``und``, score 0 and no proportions. Only the text is looked at. Rows are judged one by one,
    so repeated rows and rows without an id stay as they are, and an empty table gives an empty result. Long
    texts are read whole, a million characters at a time; a task holds the distinct grams of some documents.
    """
    names, p = model
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(p)
    # a carried text is sent to the workers once
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry) if c != text]
    places, at = [], 0
    for c in carry:
        at += c != text
        places.append(0 if c == text else at)
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (b.slice(i, 1000) for b in rows for i in range(0, len(b), 1000)):
            texts, shares = batch.column(0).to_pylist(), {}
            waiting, size = [], 0
            for i, t in enumerate(texts):
                at, n = _counts(t) if t and names else ((), ())
                if len(at):
                    waiting.append((i, (at, n)))
                    size += len(at)
                if waiting and (size > 400_000 or i == len(texts) - 1):
                    shares |= dict(zip((k for k, _ in waiting), _infer([x for _, x in waiting], model, penalty)))
                    waiting, size = [], 0
            if waiting:
                shares |= dict(zip((k for k, _ in waiting), _infer([x for _, x in waiting], model, penalty)))
            w = [shares.get(i) for i in range(len(texts))]
            top = [None if x is None else int(x.argmax()) for x in w]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in places),
                    pa.array([UNKNOWN if k is None else names[k] for k in top], pa.string()),
                    pa.array([0.0 if k is None else min(1.0, float(x[k])) for k, x in zip(top, w)], pa.float64()),
                    pa.array([[] if x is None else [(names[k], float(x[k])) for k in np.flatnonzero(x > 0)] for x in w], pa.map_(pa.string(), pa.float64())),
                ],
                names=[*(f"c{i}" for i in range(len(carry))), "lang_pred", "score", "proportions"],
            )

    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(kinds)) + ", lang_pred string, score double, proportions map<string,double>"
    out = docs.select(F.col(text).alias("text"), *columns).mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "lang_pred", "score", "proportions")
