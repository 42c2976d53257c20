"""Substring dedup: windows of words that also start in an earlier document, found by FM-indexes over shards."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import mix, sliding_min, utf8_words, written
from wattloom.llm.fmindex import FMIndex, LeastOwner

GRAM = 8
CHUNK = 1 << 18  # bytes of text that are hashed together
_NONE = np.iinfo(np.int64).max
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_END = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * _ODD)  # a number for each byte and place in a word, modulo 64


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash: the sum of its bytes' numbers. Equal words have equal hashes."""
    code = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[code]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    return starts, np.add.reduceat(_BYTES[(place & 63) << 8 | code[inside]], first)


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """Anchor of each window of words: the smallest hash of its grams. Equal windows have equal anchors."""
    if len(h) < window:
        return np.empty(0, dtype=np.uint64)
    k = min(GRAM, window)
    grams = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        grams *= _ODD
        grams += h[i : len(h) - k + 1 + i]
    return sliding_min(mix(grams), window - k + 1)


def _text_anchors(texts: list[str | None], window: int) -> Iterator[np.ndarray]:
    """Anchors of each text's windows. Short texts are hashed together, long ones in parts that end between words."""
    held, size = [], 0

    def together() -> Iterator[np.ndarray]:
        starts, h = _word_hashes(b"\n".join(held))
        anchors = _anchors(h, window)
        ends = np.searchsorted(starts, np.cumsum([len(raw) + 1 for raw in held])).tolist()
        # windows that reach into the next text belong to none
        yield from (anchors[a : max(a, b - window + 1)] for a, b in zip([0, *ends], ends))

    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(raw) > CHUNK:
            yield from together()
            held, size = [], 0
        if len(raw) <= CHUNK:
            held.append(raw)
            size += len(raw)
            continue
        parts, at = [], 0
        while at < len(raw):
            end = _END.search(raw, at + CHUNK)
            end = end.start() if end else len(raw)
            parts.append(_word_hashes(raw[at:end])[1])
            at = end
        yield _anchors(np.concatenate(parts), window)
    if held:
        yield from together()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """doc, own, anchor: the distinct anchors of each row's text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [np.unique(a) for a in _text_anchors(batch.column(2).to_pylist(), window)]
            sizes = [len(a) for a in out]
            doc, own = (np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1))
            flat = _signed(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)
            for i in range(0, max(len(flat), 1), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 200_000]) for c in (doc, own, flat)], names=["doc", "own", "anchor"])

    return docs.mapInArrow(run, "doc long, own long, anchor long")


def _stretches(anchors: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, as first window and number; windows under ``single`` stand alone."""
    new = np.concatenate(([True], anchors[1:] != anchors[:-1])) | single
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(anchors)))


_PART = "doc long, own long, route long, c1 long, c2 long, start long, windows long, body binary"


def _parts(docs: DataFrame, window: int) -> DataFrame:
    """Stretches of windows whose anchor other documents have too.

    A stretch goes by its anchor, or alone window by window where many documents have the anchor; c1 and c2
    are a 128-bit hash of its words, which a task sends only with its first sight of them.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, out = OrderedDict(), []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = [c.split()[0] for c in _PART.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in rows:
            doc_, own_, texts, few_, many_ = (batch.column(i).to_pylist() for i in range(5))
            for doc, own, text, few, many, anchors in zip(doc_, own_, texts, few_, many_, _text_anchors(texts, window)):
                words = utf8_words(text)
                hot = np.isin(anchors, np.array(many or [], dtype=np.int64).view(np.uint64))
                chosen = hot | np.isin(anchors, np.array(few or [], dtype=np.int64).view(np.uint64))
                for first, n in zip(*_stretches(anchors, hot)):
                    if not chosen[first]:
                        continue
                    body = b" ".join(words[first : first + n + window - 1])
                    c = xxhash.xxh3_128_intdigest(body)
                    c1, c2 = (c >> 64) - (1 << 63), (c & (1 << 64) - 1) - (1 << 63)
                    route = c1 if hot[first] else int(anchors[first].view(np.int64))
                    if c in sent:
                        body = None
                        sent.move_to_end(c)
                    else:
                        sent[c] = None
                        if len(sent) > 200_000:
                            sent.popitem(last=False)
                    out.append((doc, own, route, c1, c2, int(first), int(n), body))
                    if len(out) >= 4_000:
                        yield flush()
        if out:
            yield flush()

    return docs.mapInArrow(run, _PART)


def _search(contents: DataFrame, window: int, shard_words: int) -> DataFrame:
    """Per content its windows that also start in a document before ``doc``, as first windows and ends, in turn.

    Contents of a route lie together in a partition; a shard of whole routes is indexed, and each of its
    contents streamed through the index.
    """

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        numbers: dict = {}
        bodies = [[numbers.setdefault(w, len(numbers) + 1) for w in r[4].split(b" ")] for r in rows]
        sizes = np.array([len(b) for b in bodies], dtype=np.int64)
        # a zero ends each content, and no pattern has it
        text = np.fromiter((w for b in bodies for w in (*b, 0)), dtype=np.int64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        owner = np.repeat(np.array([r[3] for r in rows], dtype=np.int64), sizes + 1)
        least = LeastOwner(FMIndex(text, len(numbers) + 1, window + 1), owner, window)
        early = least.match(text, starts, sizes, _NONE) < owner
        spans = []
        for s, n in zip(starts, sizes):
            mine = early[s : s + n].astype(np.int8)
            spans.append(np.flatnonzero(np.diff(np.concatenate(([0], mine, [0])))).tolist())
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.int64()))], names=["c1", "c2", "least", "early"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= shard_words and r[0] != held[-1][0]:
                    yield shard(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[4]) // 6
        if held:
            yield shard(held)

    placed = contents.select("route", "c1", "c2", "least", "body").repartition("route").sortWithinPartitions("route", "c1", "c2")
    return placed.mapInArrow(run, "c1 long, c2 long, least long, early array<long>")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """Applies the spans of windows: removed spans of words, and the words that are left; columns beyond are passed on."""
    more = docs.columns[4:]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = utf8_words(text)
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans or ():
                    edge[s["lo"]] += 1
                    edge[s["hi"] + window - 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if spans else b" ".join(words)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
                out.append((len(words), int(gone.sum()), kept.decode("utf-8", "surrogatepass"), edges))
            n, gone, kept, edges = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(edges, pa.list_(pa.int64())), batch.column(3), *([batch.column(1), batch.column(4)] if more else [])],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed", "text_hash", *(["text", "row"] if more else [])],
            )

    passed = f", text string, row {docs.schema['row'].dataType.simpleString()}" if more else ""
    return docs.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_text string, removed array<long>, text_hash long{passed}")


def repeated_substrings(
    docs: DataFrame, window: int = 50, many: int = 4_000, doc_id: str = "doc_id", text: str = "text", shard_words: int = 1_000_000, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by a space), removed (starts and ends of spans, in turn) and
    text_hash (``xxhash64`` of the text). With ``carry``, also text and ``row``, a struct of those columns.

    A word is removed if it lies in ``window`` consecutive words whose sequence also starts in a document with a
    smaller doc_id; windows are judged on the input. Windows are routed by their anchor, the smallest hash of
    their 8-grams, as stretches with one anchor. Only stretches whose anchor two documents share are looked at,
    and equal ones are merged first: of a merged stretch, every document but the first loses all windows, so
    just the first goes through the index of its shard. Where more than ``many`` documents share an anchor its
    windows are routed one by one, so that equal ones merge and different ones spread.

    A null or empty text has no words. Rows with equal ids are one document's: none is earlier, and
    each text is cut by itself, by documents before. Rows without an id come before all others. An empty table gives an empty result.
    doc_id is an integer. Words of a text of any length are compared whole; a task holds a shard, one
    document, and up to 200,000 hashes.
    """
    # rows of one id are told apart by their texts
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("own"), F.col(text).alias("text"),
        *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")] if carry else []),
    )
    anchors = written(_anchor_rows(rows.select("doc", "own", "text"), window), "anchors")
    # documents are counted by the smallest and the largest id, and roughly for the split: repeated rows may count twice
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b")
    mine = anchors.join(shared.select("anchor", (F.col("n") > many).alias("hot")), "anchor")
    mine = mine.groupBy("doc", "own").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("few"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("many")
    )
    # the same columns by the same keys here and in the last join: texts are shuffled once
    parts = _parts(rows.join(mine, ["doc", "own"]).select("doc", "own", "text", "few", "many", *rows.columns[3:]), window)
    contents = parts.groupBy("route", "c1", "c2").agg(F.min("doc").alias("least"), F.max("body").alias("body"))
    found = _search(contents, window, shard_words).select(F.col("c1").alias("_1"), F.col("c2").alias("_2"), "least", "early")
    hit = parts.select("doc", "own", "c1", "c2", "start", "windows").join(found, (F.col("c1") == F.col("_1")) & (F.col("c2") == F.col("_2")))
    every = F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("windows")).alias("hi")))
    places = F.sequence(F.lit(0), (F.size("early") / 2).cast("int") - 1)
    some = F.transform(
        places, lambda i: F.struct((F.col("start") + F.get("early", 2 * i)).alias("lo"), (F.col("start") + F.get("early", 2 * i + 1)).alias("hi"))
    )
    spans = F.when(F.col("doc") > F.col("least"), every).when(F.size("early") > 0, some)
    spans = hit.select("doc", "own", spans.alias("s")).where(F.col("s").isNotNull()).groupBy("doc", "own").agg(F.flatten(F.collect_set("s")).alias("spans"))
    out = _kept(rows.join(spans, ["doc", "own"], "left").select("doc", "text", "spans", "own", *rows.columns[3:]), window)
    return out.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))
