"""Near-duplicates: a chosen-path set similarity join over word shingles, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import WordHashes, cut, gram_hashes, mix, utf8_words, written

SHINGLE = 5
COORDINATES = 96  # minwise tokens a set; an estimate from them has a deviation under 0.04 at 0.85
MISSED = 1e-6  # chance that a pair at the threshold meets in no node, if all its nodes stay large
DEPTH = 3  # levels; a level loses pairs and makes nodes smaller, and what stays large is compared exactly
SMALL = 48
PART, BLOCK = 1000, 500  # sets of a large node in one group, and sets compared with them
BLOCK_ITEMS = 500_000  # shingles of the sets on either side of one group
PIVOTS = 16
PIECE = 200_000  # links that one task contracts
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if there are fewer words."""
    words = hashes.of(utf8_words(text, lower=True))
    return np.unique(gram_hashes(words, min(SHINGLE, len(words)))) if len(words) else words


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The set's minwise token in each coordinate."""
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096, None] * _SEEDS[None, :]) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def _short(tokens: np.ndarray) -> np.ndarray:
    """One byte a token. Different tokens share a byte once in 256 times, which may only add candidates."""
    return (mix(tokens.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def _sets(docs: DataFrame, trees: int) -> DataFrame:
    """doc, n, c1, c2 (128-bit hash of the set), roots (a minwise token a tree) and tokens (all, a byte each) of every document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            out = []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, hashes)
                place = np.arange(1, len(s) + 1, dtype=np.uint64)
                c1, c2 = (int(mix(s * place + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (3, 7))
                tokens = minwise(s)
                out.append((len(s), c1, c2, tokens[:trees].astype("<u4").tobytes(), _short(tokens).tobytes()))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.binary()) for c in columns[3:])],
                names=["doc", "n", "c1", "c2", "roots", "tokens"],
            )

    return docs.mapInArrow(run, "doc long, n long, c1 long, c2 long, roots binary, tokens binary")


def _roots(classes: DataFrame, trees: int) -> DataFrame:
    """First level of every tree: a set goes to the node of one of its minwise tokens."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.num_rows
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(n, trees).astype(np.uint64)
            node = mix(tokens * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, trees + 1, dtype=np.uint64)[None, :])
            doc = np.repeat(batch.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(node.ravel().view(np.int64)), pa.array(doc)], names=["node", "doc"])

    return classes.select("doc", "roots").mapInArrow(run, "node long, doc long")


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """The next level: each set of a node goes on by two of its minwise tokens, chosen by the node's path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            node = batch.column(0).to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(k, COORDINATES)
            nodes = []
            for j in (1, 2):
                path = mix(node + np.uint64(2 * level + j))
                token = tokens[np.arange(k), (path % np.uint64(COORDINATES)).astype(np.int64)].astype(np.uint64)
                nodes.append(mix(path ^ mix(token)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), batch.column(1).take(pa.array(np.tile(np.arange(k), 2)))], names=["node", "doc"])

    return rows.select("node", "doc", "tokens").mapInArrow(run, "node long, doc long")


@lru_cache
def least_shared(threshold: int) -> int:
    """How many coordinates two sets at the threshold share at least, but with probability ``MISSED``; fewer are no candidates."""
    s, below = threshold / 100, 0.0
    for k in range(COORDINATES + 1):
        below += comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k)
        if below > MISSED:
            return k
    return COORDINATES


def _estimates(tokens: np.ndarray, sizes: np.ndarray, threshold: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows, those whose sizes allow a link, and how many coordinates they share."""
    a, b = sizes[i], sizes[j]
    fits = 100 * np.minimum(a, b) >= threshold * np.maximum(a, b)
    i, j = i[fits], j[fits]
    same = np.concatenate([(tokens[i[k : k + 2000]] == tokens[j[k : k + 2000]]).sum(axis=1) for k in range(0, len(i), 2000)] or [np.empty(0, dtype=np.int64)])
    good = same >= least_shared(threshold)
    return np.stack((i[good], j[good])), same[good]


def _thinned(docs: np.ndarray, pairs: np.ndarray, same: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of documents, the most alike first, without those that others already tie.

    Two sets are tied by a chain of pairs that share nearly all coordinates, or by an equal label.
    """
    first: dict[int, int] = {}
    parent = [first.setdefault(x, k) for k, x in enumerate(labels.tolist())]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-same, kind="stable").tolist():
        a, b = pairs[0, k], pairs[1, k]
        if root(a) == root(b):
            continue
        out.append((int(min(docs[a], docs[b])), int(max(docs[a], docs[b]))))
        if same[k] >= 0.96 * COORDINATES:
            parent[root(a)] = root(b)
    return out


def _columns(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = group["doc"].to_numpy()
    return docs, group["n"].to_numpy(), np.frombuffer(b"".join(group["tokens"].to_pylist()), dtype=np.uint8).reshape(len(docs), COORDINATES)


def _in_node(group: pa.Table, threshold: int, thin: bool) -> list[tuple[int, int]]:
    """Candidates of a small node: all pairs are compared but those with equal labels."""
    docs, sizes, tokens = _columns(group)
    labels = group["label"].to_numpy()
    i, j = np.triu_indices(len(docs), 1)
    apart = labels[i] != labels[j]
    pairs, same = _estimates(tokens, sizes, threshold, i[apart], j[apart])
    if thin:
        return _thinned(docs, pairs, same, labels)
    ids = docs[pairs]
    return list(zip(ids.min(axis=0).tolist(), ids.max(axis=0).tolist()))


def _pairs(out: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _part(salt: int, parts: str) -> Column:
    return F.pmod(F.xxhash64("doc", "node", F.lit(salt)), F.col(parts))


def _pivot_pairs(rows: DataFrame, threshold: int) -> DataFrame:
    """Candidates that tie most of a large node: each set with the pivot it is most like, and pivots with each other.

    A node is cut in parts of about ``PART`` sets; its pivots, about ``PIVOTS`` drawn by hash, go to all parts.
    A document's hash is the same in every node, so nodes of one group have pivots, and pairs, in common.
    """
    parts = rows.withColumn("parts", F.ceil(F.col("size") / PART)).withColumn("pivot", F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) * F.col("size") < PIVOTS << 30)
    part = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(_part(1, "parts")))
    parts = parts.select("node", "doc", "n", "tokens", "pivot", F.explode(part).alias("part"))

    def compare(group: pa.Table) -> pa.Table:
        docs, sizes, tokens = _columns(group)
        pivot = group["pivot"].to_numpy()
        p, r = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        pairs, same = _estimates(tokens, sizes, threshold, np.repeat(r, len(p)), np.tile(p, len(r)))
        order = np.lexsort((docs[pairs[1]], -same, pairs[0]))
        best = pairs[:, order[np.unique(pairs[0][order], return_index=True)[1]]]
        if group["part"][0].as_py() == 0:
            i, j = np.triu_indices(len(p), 1)
            best = np.concatenate((best, _estimates(tokens, sizes, threshold, p[i], p[j])[0]), axis=1)
        ids = docs[best]
        return _pairs(list(zip(ids.min(axis=0).tolist(), ids.max(axis=0).tolist())))

    return parts.groupBy("node", "part").applyInArrow(compare, "a long, b long").distinct()


def _apart(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
    """Pairs that no component of ``found`` holds."""
    if found is None:
        return pairs
    for end in "ab":
        pairs = pairs.join(found.select(F.col("doc").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the nodes that hold more than one component."""
    label = _labelled(rows.select("node", "doc"), found).groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return rows.join(label.where("lo < hi").select("node"), "node", "left_semi")


def _labelled(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows with the component of their document, its own id if it has none."""
    if found is None:
        return rows.withColumn("label", F.col("doc"))
    return rows.join(found.select("doc", "component"), "doc", "left").withColumn("label", F.coalesce("component", "doc"))


def small_pairs(small: DataFrame, found: DataFrame | None, threshold: int, thin: bool = True) -> DataFrame:
    """Candidates within small nodes, but for pairs that one component of ``found`` already holds; ``thin``: see :func:`_thinned`."""

    def compare(group: pa.Table) -> pa.Table:
        return _pairs(_in_node(group, threshold, thin))

    return _labelled(small, found).select("node", "doc", "n", "tokens", "label").groupBy("node").applyInArrow(compare, "a long, b long")


def _full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """doc, items: the whole sets of the documents in ``needed``, but for empty ones of rows that repeat an id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for i in range(0, batch.num_rows, 200):
                texts = batch.column(1).slice(i, 200).to_pylist()
                found = [shingle_set(t, hashes).astype("<u8").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 200), pa.array(found, pa.binary())], names=["doc", "items"])

    return written(docs.join(needed.select("doc").distinct(), "doc", "left_semi").select("doc", "text").mapInArrow(run, "doc long, items binary").where("length(items) > 0"), "sets")


def _coded(items: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of sets, and their items one set after the other, numbered densely."""
    sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in items]
    return np.array([len(x) for x in sets], dtype=np.int64), np.unique(np.concatenate(sets), return_inverse=True)[1]


def rest_links(large: DataFrame, found: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """a, b: links between sets of a large node that ``found``, components of confirmed links, has apart.

    All sets outside a node's largest component are compared with every set of the node in another component, in
    blocks of parts, so no pair of a node is left out: it is compared, or links already join both. A block has
    the whole sets, of bounded total size, and gives at most one link for each of its sets.
    """
    rows = _labelled(large, found)
    top = rows.groupBy("node", "label").agg(F.count("*").alias("k"), F.sum("n").alias("m")).groupBy("node")
    top = top.agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max(F.struct("k", "label", "m")).alias("most"), F.sum("k").alias("all"), F.sum("m").alias("m"))
    top = top.where("most.k < all").select(
        "node",
        "main",
        F.ceil(F.greatest((F.col("all") - F.col("most.k")) / BLOCK, (F.col("m") - F.col("most.m")) / BLOCK_ITEMS)).alias("blocks"),
        F.ceil(F.greatest(F.col("all") / PART, F.col("m") / BLOCK_ITEMS)).alias("parts"),
    )
    rows = rows.join(top, "node").withColumn("rest", F.col("label") != F.col("main"))
    rows = rows.join(_full_sets(docs, rows), "doc")
    zero = F.lit(0).cast("long")
    base = ["node", "doc", "label", "rest", "items"]
    asked = rows.where("rest").select(*base, F.lit(True).alias("asks"), _part(2, "blocks").alias("block"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    others = rows.select(*base, F.lit(False).alias("asks"), _part(1, "parts").alias("part"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))

    def compare(group: pa.Table) -> pa.Table:
        ids, labels, rest, asks = (group[c].to_numpy() for c in ("doc", "label", "rest", "asks"))
        sizes, codes = _coded(group["items"])
        places = np.cumsum(sizes) - sizes
        other = np.flatnonzero(~asks)
        other = other[np.argsort(sizes[other], kind="stable")]
        if not len(other):
            return _pairs([])
        flat = np.concatenate([codes[places[k] : places[k] + sizes[k]] for k in other])
        first = np.cumsum(sizes[other]) - sizes[other]
        has, joined, out = np.zeros(codes.max() + 1, dtype=bool), labels.copy(), []
        for i in np.flatnonzero(asks):
            # sizes that allow a link lie together; of two sets that both ask, the one with the smaller id does
            lo, hi = np.searchsorted(sizes[other], (-(-threshold * sizes[i] // 100), 100 * sizes[i] // threshold + 1))
            j = other[lo:hi]
            apart = (joined[j] != joined[i]) & (~rest[j] | (ids[j] > ids[i]))
            if not apart.any():
                continue
            mine = codes[places[i] : places[i] + sizes[i]]
            has[mine] = True
            both = np.add.reduceat(has[flat[first[lo] : first[hi - 1] + sizes[j[-1]]]], first[lo:hi] - first[lo], dtype=np.int64)
            has[mine] = False
            for k in j[apart & (100 * both >= threshold * (sizes[i] + sizes[j] - both))]:
                if joined[k] != joined[i]:
                    out.append((int(min(ids[i], ids[k])), int(max(ids[i], ids[k]))))
                    joined[joined == joined[k]] = joined[i]
        return _pairs(out)

    return asked.unionByName(others).groupBy("node", "block", "part").applyInArrow(compare, "a long, b long").distinct()


def missed(threshold: int, trees: int, depth: int) -> float:
    """The chance that two sets at the threshold meet in no last node, if no node of theirs ends before.

    They share a number of the coordinates that is binomial. All trees draw from the same coordinates, so only
    for a given share are draws independent; a node whose two branches both lose the pair has lost it.
    """
    s, out = threshold / 100, 0.0
    for k in range(COORDINATES + 1):
        apart, lost = 1 - k / COORDINATES, 0.0
        for _ in range(depth - 1):
            lost = (apart + (1 - apart) * lost) ** 2
        out += comb(COORDINATES, k) * s**k * (1 - s) ** (COORDINATES - k) * (apart + (1 - apart) * lost) ** trees
    return out


def shape(threshold: int) -> tuple[int, int]:
    """The fewest trees that miss a pair at the threshold with probability ``MISSED`` or less, and their levels."""
    for depth in range(DEPTH, 0, -1):
        for trees in range(1, COORDINATES + 1):
            if missed(threshold, trees, depth) <= MISSED:
                return trees, depth
    raise ValueError(f"{COORDINATES} coordinates are too few for a threshold of {threshold}")


def branched(
    classes: DataFrame, docs: DataFrame, trees: int | None = None, threshold: int = 85, depth: int | None = None, small: int = SMALL
) -> tuple[DataFrame, DataFrame | None, DataFrame | None, DataFrame | None]:
    """Nodes of at most ``small`` sets, as rows of node, doc, n, tokens and size; those still larger at the last level; links and their components.

    Two sets with similarity s share a tree's first node with probability s. Nodes of at most ``small`` sets end
    there. Larger ones are first tied through pivots, by confirmed links. A node that then lies in one component
    has nothing left to find and ends; others branch, up to ``depth`` levels. Trees and levels not given are
    those of :func:`shape`.
    """
    fit = shape(threshold) if trees is None or depth is None else (trees, depth)
    trees, depth = trees or fit[0], depth or fit[1]
    nodes, done, large, links, found = _roots(classes, trees), [], None, None, None
    sets = classes.select("doc", "n", "tokens")
    for level in range(depth):
        count = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        rows = nodes.join(count, "node").join(sets, "doc")
        rows = written(rows.select("node", "doc", "n", "tokens", "size"), f"nodes{level}")
        done.append(rows.where(F.col("size") <= small))
        large = rows.where(F.col("size") > small)
        if large.isEmpty():
            large = None
            break
        tied = cut(confirm(cut(_apart(_pivot_pairs(large, threshold), found)), docs, threshold))
        links = tied if links is None else links.union(tied)
        found = components(links)
        # written, as the next level and the last comparison read it several times
        large = written(_mixed(large, found), f"mixed{level}")
        if large.isEmpty():
            large = None
            break
        if level == depth - 1:
            break
        # without tokens, and written, as nodes are counted first and joined with the counts after
        nodes = written(_branches(large, level), f"branches{level}")
    return reduce(DataFrame.union, done), large, links, found


def linked(classes: DataFrame, docs: DataFrame, threshold: int, trees: int | None = None) -> DataFrame:
    """doc, component of every set with a link.

    Large groups are tied first, through the pivots of their nodes. All other pairs of a node are then
    compared unless the links confirmed so far already join them. In small nodes, chains of pairs that look the
    same stand for the pairs they tie; where such a chain is not confirmed, those pairs are compared after it.
    """
    small, large, links, found = branched(classes, docs, trees, threshold)
    if large is not None:
        links = links.union(cut(rest_links(large, found, docs, threshold)))
        found = components(links)
    pairs = cut(small_pairs(small, found, threshold).distinct())
    tied = cut(confirm(pairs, docs, threshold))
    links = tied if links is None else links.union(tied)
    found = components(links)
    # pairs left out for a chain between them, if not all of the chain was confirmed
    rest = cut(small_pairs(small, found, threshold, thin=False).distinct().join(pairs, ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else components(links.union(confirm(rest, docs, threshold)))


def confirm(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Those pairs with 100 * intersection >= threshold * union of the full sets."""

    def check(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = _full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    x = full.select(F.col("doc").alias("a"), F.col("items").alias("x"))
    y = full.select(F.col("doc").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _contracted(links: DataFrame) -> DataFrame:
    """u, v: links with the same components, each document tied to the smallest one that ``PIECE`` links of its task reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

        held = 0
        for batch in batches:
            if held + batch.num_rows > PIECE and held:
                yield stars()
                held = 0
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
            held += batch.num_rows
        yield stars()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """doc, component: the smallest document each linked document reaches.

    Pieces of up to ``PIECE`` links are contracted first, each in a task. Of several pieces, alternating stars do the
    rest: neighbours are tied to the smallest of a neighbourhood until nothing changes. Minima are aggregated before
    they meet the links, and lineage is cut each round.
    """
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    pieces = -(-links.count() // PIECE)
    links = cut(_contracted(links.coalesce(max(1, pieces))))
    state = None
    while pieces > 1:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        links = up.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = cut(links.select("e.u", "e.v").where("u <> v").distinct())
        new = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return links.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text", trees: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked where 100 * intersection >= threshold * union of their sets of 5-word shingles (A-Z
    lower-cased; fewer words are one shingle). component_id is the smallest doc_id reachable over links, and
    kept whether that is the row itself. Equal sets are one class from the start, represented by its smallest
    document, so copies cost nothing; classes are joined by :func:`linked`, and links confirmed on full sets.
    ``trees`` is by default as many as :func:`shape` finds for the threshold.

    A null or empty text has an empty set and is linked with nothing. Rows with equal ids and texts get equal
    results; rows with equal ids and other texts share a component. doc_id is an integer; a row without one is
    linked with nothing, has no component and is kept. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    trees = trees or shape(threshold)[0]
    sets = written(_sets(rows, trees), "minwise")
    some = sets.where("n > 0 AND doc IS NOT NULL")
    same = some.groupBy("c1", "c2", "n").agg(F.min("doc").alias("first"))
    classes = some.join(same.select(F.col("first").alias("doc"), F.col("c1").alias("_1"), F.col("c2").alias("_2")), "doc").where("c1 = _1 AND c2 = _2")
    classes = classes.select("doc", "n", "roots", "tokens").dropDuplicates(["doc"])
    found = linked(classes, rows.where("doc IS NOT NULL"), threshold, trees)
    # a class's documents have its component, found through its first document
    same = same.join(found.select(F.col("doc").alias("first"), "component"), "first", "left")
    same = same.select("c1", "c2", "n", F.coalesce("component", "first").alias("component"))
    out = sets.select("doc", "n", "c1", "c2").join(same, ["c1", "c2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept")
    )
