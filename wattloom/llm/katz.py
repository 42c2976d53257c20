"""Katz backoff language model: Good-Turing discounted bigrams over unigrams, normalised exactly.

Documents are dealt into blocks by a hash, n-gram tables into partitions by a hash of the n-gram. A block sends each
partition its own sorted n-grams with their counts, and gets back, in the same order, what the whole
table says of them. So keys travel once, a frequent n-gram is one entry a block however often it occurs, and
what a block or a partition holds is bounded by its size:

1. blocks send unigram and bigram counts of training documents; partitions return the totals, name one owner block
   for each seen bigram, and tell how many n-grams occur 1, 2, ... times, from which the discounts follow;
2. owners send, for each context word, the discounted count and the unigram probability of its seen bigrams;
   partitions return the sums, from which the backoff weights follow;
3. blocks score their documents token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import mix, utf8_words

ORDERS = 5  # counts up to this are discounted
END = np.uint64(0x9AE16A3B2F90404F)
START = np.uint64(0xC949D7C7509E6557)
_BLOCK_BYTES = 16 << 20


def _zip(*arrays: np.ndarray) -> list[bytes]:
    press = zstandard.ZstdCompressor(level=1).compress
    return [press(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unzip(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def _press_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the planes of their differences' bytes: the upper planes are nearly all zero."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted keys pass from one partition to the next: partitions are equal ranges of the hash."""
    width = (1 << 64) // parts
    bounds = np.array([width * i for i in range(1, parts)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


class _Numbers(dict):
    """Numbers from 1 for words, in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """The documents of a block as word hashes; contexts are shifted by one, after ``START``."""

    def __init__(self, docs: pa.Table):
        self.train = np.array(docs["train"].to_pylist(), dtype=bool)
        numbers = _Numbers()
        number = numbers.__getitem__
        words = []
        for t in docs["text"].to_pylist():
            w = utf8_words(t, lower=True)
            words.append(np.fromiter(map(number, w), dtype=np.int64, count=len(w)))
            words.append(np.zeros(1, dtype=np.int64))
        self.sizes = np.array([len(w) + 1 for w in words[::2]], dtype=np.int64)
        met = np.concatenate(words)
        hashes = np.array([int(END), *map(xxhash.xxh3_64_intdigest, numbers)], dtype=np.uint64)
        order = np.argsort(hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.word_at = hashes[order], place[met]
        self.starts = np.cumsum(self.sizes) - self.sizes
        context = np.empty(len(met), dtype=np.uint64)
        context[1:] = hashes[met[:-1]]
        context[self.starts] = START
        pair = mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(hashes)[met])
        trained = np.repeat(self.train, self.sizes)
        order = np.argsort(pair)
        ordered = pair[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        self.pair_at = np.empty_like(order)
        self.pair_at[order] = np.cumsum(new) - 1
        first = order[new]
        self.pairs, self.pair_context, self.pair_word = ordered[new], context[first], self.word_at[first]
        self.word_count = np.bincount(self.word_at, weights=trained, minlength=len(self.words)).astype(np.int64)
        self.pair_count = np.bincount(self.pair_at, weights=trained, minlength=len(self.pairs)).astype(np.int64)

    def contexts(self) -> np.ndarray:
        """Each bigram's context as a place among the words: a context's count is that of its word, START's that of END."""
        return np.searchsorted(self.words, np.where(self.pair_context == START, END, self.pair_context))


_SENT = "block long, part long, k1 binary, v1 binary, k2 binary, v2 binary"
_GOT = "block long, part long, v1 binary, v2 binary, many binary, own binary, hist array<long>"
_MASS = "block long, part long, v1 binary, v2 binary, many binary, own binary, hist array<long>, k3 binary, k4 binary, a3 binary, b3 binary"


def _types(names: list[str]) -> pa.Schema:
    kinds = {"block": pa.int64(), "part": pa.int64(), "hist": pa.list_(pa.int64())}
    return pa.schema([(n, kinds.get(n, pa.binary())) for n in names])


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    schema = _types([c.split()[0] for c in names.split(", ")])
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [[] for _ in schema], schema=schema)


def _totals(sent: pa.Table) -> pa.Table:
    """One partition: totals of each block's n-grams, the owner of each seen bigram, and counts of counts."""
    sent = sent.to_pylist()
    sent.sort(key=lambda r: r["block"])
    answers, hist = [], []
    for k, v in (("k1", "v1"), ("k2", "v2")):
        keys, counts = [_keys(r[k]) for r in sent], [_unzip(r[v], "<u4").astype(np.int64) for r in sent]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        total = np.bincount(inverse, weights=flat, minlength=len(distinct)).astype(np.int64)
        # the first block, in order, with the n-gram in a training document
        first = np.full(len(distinct), -1, dtype=np.int64)
        seen = np.flatnonzero(flat)[::-1]
        first[inverse[seen]] = seen
        owned = np.zeros(len(flat), dtype=np.uint8)
        owned[first[first >= 0]] = 1
        many = np.bincount(inverse, minlength=len(distinct)) > 1
        ends = np.cumsum([len(x) for x in keys])[:-1]
        answers.append((np.split(total[inverse], ends), np.split(owned, ends), np.split(many[inverse], ends)))
        hist += [int((total == r).sum()) for r in range(1, ORDERS + 2)] + [int((total > 0).sum()), int(total.sum())]
    out = []
    for i, r in enumerate(sent):
        v1, v2 = answers[0][0][i], answers[1][0][i]
        out.append((r["block"], r["part"], *_zip(v1.astype("<u4"), v2.astype("<u4"), np.packbits(answers[0][2][i]), np.packbits(answers[1][1][i])), hist))
    return _rows(_GOT, out)


class Model:
    """What a block knows of the model, from the partitions' answers in partition order."""

    def __init__(self, block: Block, got: list[dict]):
        got = sorted(got, key=lambda r: r["part"])
        hist = np.sum([r["hist"] for r in got], axis=0)
        n = ORDERS + 3
        self.unigrams, self.tokens = int(hist[n - 2]), int(hist[n - 1])
        self.d1, self.d2 = discounts(hist[: ORDERS + 1]), discounts(hist[n : n + ORDERS + 1])
        self.c1 = np.concatenate([_unzip(r["v1"], "<u4") for r in got]).astype(np.float64)
        self.c2 = np.concatenate([_unzip(r["v2"], "<u4") for r in got]).astype(np.float64)

        def flags(name: str, keys: np.ndarray) -> np.ndarray:
            sizes = np.diff(_cuts(keys, len(got)))
            return np.concatenate([np.unpackbits(_unzip(r[name], "u1"), count=k) for r, k in zip(got, sizes)]).astype(bool)

        # seen words that other blocks have too: what is known of them as contexts must be put together
        self.shared = flags("many", block.words) & (self.c1 > 0)
        self.own = flags("own", block.pairs)
        # unigrams over the seen words and one unknown word, which has what discounting leaves
        left = 1.0
        if self.tokens:
            self.p1 = discounted(self.c1, self.d1) / self.tokens
            r = np.arange(1, ORDERS + 1)
            left = float((hist[:ORDERS] * r * (1 - self.d1)).sum()) / self.tokens
            if left <= 0:
                self.p1 *= self.tokens / (self.tokens + 1)
                left = 1 / (self.tokens + 1)
        else:
            self.p1 = np.zeros(len(self.c1))
        self.unknown = left
        self.p1 = np.where(self.c1 > 0, self.p1, left)
        # of the seen bigrams that the block owns, summed by context: discounted counts, and the words' p1
        self.context = block.contexts()
        share = discounted(self.c2, self.d2)
        mine = self.own & (self.c2 > 0)
        self.mass = np.bincount(self.context[mine], weights=share[mine], minlength=len(block.words))
        self.base = np.bincount(self.context[mine], weights=self.p1[block.pair_word[mine]], minlength=len(block.words))
        # contexts whose sums decide a score here: one with an unseen bigram, or without any discounted one
        sure, ask = np.zeros(len(block.words), dtype=bool), np.ones(len(block.words), dtype=bool)
        sure[self.context[(self.c2 > 0) & (self.c2 <= ORDERS)]] = True
        ask[sure] = False
        ask[self.context[self.c2 == 0]] = True
        self.ask = ask & self.shared


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 1 to k, from the numbers n of n-grams that occur 1 to k + 1 times.

    Good-Turing's r* = (r + 1) n[r+1] / n[r], corrected so that larger counts stay as they are. Where the
    counts of counts are too thin for a factor between 0 and 1, half an occurrence is taken off.
    """
    k = len(n) - 1
    out = np.empty(k)
    n = n.astype(np.float64)
    cut = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        star = (r + 1) * n[r] / n[r - 1] if n[r - 1] else 0.0
        d = (star / r - cut) / (1 - cut) if cut < 1 else 0.0
        out[r - 1] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    factor = np.append(np.concatenate(([0.0], d)), 1.0)
    return c * factor[np.minimum(c, len(d) + 1).astype(np.int64)]


def _score(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each distinct bigram, and of each word alone as the base rule has it.

    p(w | h) is the discounted share of a seen bigram, or the context's backoff weight times p(w): what is left
    of the context's mass over what the unseen words have among the unigrams. A context that was never
    seen backs off with weight 1; one without any discount is scaled by c / (c + 1), so that something is left.
    """
    at = model.context
    c, mass, base = model.c1[at], model.mass[at], model.base[at]
    safe = np.maximum(c, 1.0)
    scale = np.where(c - mass < 1e-6 + 1e-13 * c, safe / (safe + 1), 1.0)
    left = 1 - scale * mass / safe
    weight = np.where(c > 0, left / np.maximum(1 - base, model.unknown), 1.0)
    p = np.where(model.c2 > 0, scale * discounted(model.c2, model.d2) / safe, weight * model.p1[block.pair_word])
    word = (model.c1 + 1) / (model.tokens + model.unigrams + 1)
    return np.log10(np.maximum(p, 1e-300)), np.log10(word)


def score(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Scores every row's whole text by a model of the rows where the boolean column ``train`` is true.

    Returns doc_id, train, n_tokens (with the end), n_known (tokens that occur in training), train_tokens,
    base_score and score: log10 probabilities of the text, the first by add-one unigrams over the seen words
    and one unknown word, the second by the model. Both spread over the same words, so they can be compared.
    A null or empty text is the end alone; a null in ``train`` is false; repeated rows and rows without an id
    are scored, and learnt from, as they are. Without a training row everything is unknown, and an empty
    table gives an empty result. A document's n-grams are counted whole, however long it is. Blocks hold about
    ``block_bytes`` of text, or one document, and there are as many partitions as blocks.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(train), F.lit(False)).alias("train")
    )
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    # equal ids or equal texts alone don't put documents together
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def counts(docs: pa.Table) -> pa.Table:
        block, name = Block(docs), docs["block"][0].as_py()
        one, two = _cuts(block.words, blocks), _cuts(block.pairs, blocks)
        out = []
        for p in range(blocks):
            a, b = slice(one[p], one[p + 1]), slice(two[p], two[p + 1])
            v1, v2 = _zip(block.word_count[a].astype("<u4"), block.pair_count[b].astype("<u4"))
            out.append((name, p, _press_keys(block.words[a]), v1, _press_keys(block.pairs[b]), v2))
        return _rows(_SENT, out)

    def mass(docs: pa.Table, got: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(_MASS, [])
        got = sorted(got.to_pylist(), key=lambda r: r["part"])
        block = Block(docs)
        model = Model(block, got)
        gives = model.shared & (model.mass > 0)
        cuts, out = _cuts(block.words, blocks), []
        for p, r in enumerate(got):
            s = slice(cuts[p], cuts[p + 1])
            k, a, b = (x[s][gives[s]] for x in (block.words, model.mass, model.base))
            known = (r["block"], p, r["v1"], r["v2"], r["many"], r["own"], r["hist"])
            out.append((*known, _press_keys(k), _press_keys(block.words[s][model.ask[s]]), *_zip(a, b)))
        return _rows(_MASS, out)

    def sums(sent: pa.Table) -> pa.Table:
        sent = sent.to_pylist()
        distinct, inverse = np.unique(np.concatenate([_keys(r["k3"]) for r in sent]), return_inverse=True)
        a, b = (np.bincount(inverse, weights=np.concatenate([_unzip(r[n], "<f8") for r in sent]), minlength=len(distinct)) for n in ("a3", "b3"))
        distinct, a, b = np.append(distinct, np.uint64(0)), np.append(a, 0.0), np.append(b, 0.0)
        out = []
        for r in sent:
            asked = _keys(r["k4"])
            at = np.searchsorted(distinct[:-1], asked)
            at = np.where(distinct[at] == asked, at, len(distinct) - 1)
            out.append((*(r[c] for c in ("block", "part", "v1", "v2", "many", "own", "hist")), b"", b"", *_zip(a[at], b[at])))
        return _rows(_MASS, out)

    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(docs: pa.Table, got: pa.Table) -> pa.Table:
        got = sorted(got.to_pylist(), key=lambda r: r["part"])
        if not docs.num_rows:
            return pa.table([docs["doc_id"], docs["train"], *([[]] * 5)], names=names)
        block = Block(docs)
        model = Model(block, got)
        model.mass[model.ask] = np.concatenate([_unzip(r["a3"], "<f8") for r in got])
        model.base[model.ask] = np.concatenate([_unzip(r["b3"], "<f8") for r in got])
        pair, word = _score(block, model)
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        return pa.table(
            [
                docs["doc_id"], docs["train"], pa.array(block.sizes), pa.array(by_doc((model.c1 > 0)[block.word_at].astype(np.int64))),
                pa.array(np.full(len(block.sizes), model.tokens)), pa.array(by_doc(word[block.word_at])), pa.array(by_doc(pair[block.pair_at])),
            ],
            names=names,
        )

    def by_part(f):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(pa.Table.from_batches(list(rows))).to_batches()

        return run

    got = rows.groupBy("block").applyInArrow(counts, _SENT).groupBy("part").applyInArrow(_totals, _GOT)
    got = rows.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(mass, _MASS).groupBy("part").applyInArrow(sums, _MASS)
    return rows.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(
        scores, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
