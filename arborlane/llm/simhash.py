"""Operator 3, SimHash near-duplicates: BK-trees over 64-bit fingerprints.

Fingerprints at most two bits apart agree in at least one of three blocks of
bits, so each distinct fingerprint goes to three shards, one for each block and
its bits.  A task builds the BK-trees of all shards that it reads at once, level
by level: the first fingerprint of a shard is the root, the others fall to the
child keyed by their Hamming distance to it, and so on.  A query follows only
the edges whose key differs from its own distance to the parent by no more than
the radius.

Trees are built where their queries are, by that one shuffle of fingerprints,
and not broadcast: a broadcast would grow with the corpus.  Copies share one
fingerprint and count once.  A shard gives a spanning forest of its links (never
all pairs); the components of the whole graph follow by alternating large-star
and small-star steps on tables.

A shard of over `ROOM` members is dealt into parts of about that size, by hash,
and each part has a tree.  Then the members that are outside the shard's largest
component so far meet every part (`cells`), so no pair is missed: two members
that never meet are in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, U64, checkpointed, chunked, compacted, mix, read, released, salted_join, scan_partitions, texts, unused

SEED, RADIUS = 42, 2
#: Blocks of bits (first bit, number), one of which at least agrees within the radius.
_BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Query-node pairs that a task may have at once, pairs whose sketches it compares at once, rows that it holds at once.
_FRONTIER, _PIECE, _HELD = 1 << 18, 1 << 14, 1 << 16
#: Members of a shard that meet in one tree; shards that may be dealt into parts (their list goes to all tasks).
ROOM, MOST_DEALT = 4096, 100_000
#: Shingles of the sets that a task compares with as many others, at once.
SET_ROOM = 1 << 20
#: Edges of a node from which on a join deals them to many tasks.
HOT = 100_000
#: The pipeline's stage: words of a shingle, similarity, anchors (two lowest hashes each), bins of its sketch, the radius of its trees.
SHINGLE, SIMILARITY, ANCHORS, BINS, WIDE_RADIUS = 5, 0.8, 10, 256, 22
#: Estimates from which pairs are candidates (five deviations below the similarity), and from which they are tried first.
ESTIMATE, STRONG = SIMILARITY - 0.12, SIMILARITY + 0.06


def shingle_digests(text: str, words: int) -> list[bytes]:
    """XXH64 digests of the text's runs of so many words (fewer: the whole; none: nothing), A-Z lower-cased."""
    own = text.encode("utf-8").translate(LOWER).split()
    if not own:
        return []
    if len(own) <= words:
        return [xxhash.xxh64_digest(b" ".join(own), SEED)]
    joined = b" ".join(own)
    ends = list(accumulate(len(w) + 1 for w in own))
    digest = xxhash.xxh64_digest
    return [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


def simhashes(digests: list[list[bytes]]) -> np.ndarray:
    """Fingerprints: a bit is 1 if set in over half of a text's hashes; 0 for a text without any."""
    out = np.zeros(len(digests), ">u8")
    some = [i for i, x in enumerate(digests) if x]
    if some:
        sizes = np.array([len(digests[i]) for i in some])
        bits = np.unpackbits(np.frombuffer(b"".join(d for i in some for d in digests[i]), np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64)
        out[some] = np.packbits(sums * 2 > sizes[:, None], axis=1).view(">u8").ravel()
    return out.astype("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, many in chunked(batches, "doc_id", "text", limit=1 << 19):
            fps = simhashes([shingle_digests(x, words) for x in many])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def build(group: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all groups (sorted): each item's root, and the edges as parent * 128 + distance (sorted) and child.

    Equal fingerprints in a group hang below each other at distance 0.
    """
    first = _starts(group)
    root = np.repeat(first, np.diff(np.append(first, len(group))))
    items = np.setdiff1d(np.arange(len(group)), first)
    at = root[items]
    edges, children = [], []
    while len(items):
        key = at * 128 + np.bitwise_count(fps[items] ^ fps[at]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        new = _starts(key)
        edges.append(key[new])
        children.append(items[new])
        at = np.repeat(items[new], np.diff(np.append(new, len(key))))
        rest = np.ones(len(items), bool)
        rest[new] = False
        items, at = items[rest], at[rest]
    if not edges:
        return root, np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge)
    return root, edge[order], child[order]


def search(group: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), a < b, of items of a group at most so far apart, in batches."""
    if not len(group):
        return
    root, edge, child = build(group, fps)
    first = _starts(group)
    size = np.repeat(np.diff(np.append(first, len(group))), np.diff(np.append(first, len(group))))
    part = np.cumsum(size) // _FRONTIER
    for lo, hi in zip(b := _starts(part), np.append(b[1:], len(part)), strict=True):
        query, node = np.arange(lo, hi), root[lo:hi]
        while len(query):
            far = np.bitwise_count(fps[query] ^ fps[node]).astype(np.int64)
            near = (far <= radius) & (node < query)
            if near.any():
                yield node[near], query[near]
            begin = np.searchsorted(edge, node * 128 + np.maximum(far - radius, 0))
            count = np.searchsorted(edge, node * 128 + far + radius, "right") - begin
            total = int(count.sum())
            ahead = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
            query, node = np.repeat(query, count), child[ahead]


class Forest:
    """Components of items that grow by pairs; keeps the pairs that joined two of them."""

    def __init__(self, labels: np.ndarray):
        """Items of equal labels are joined already."""
        self.up = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
        self.joined: list[tuple[int, int]] = []

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[x]
            if (up == x).all():
                return x
            self.up[x] = self.up[up]
            x = up

    def one(self, x: int) -> int:
        while (up := int(self.up[x])) != x:
            x = up
        return x

    def add(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]], holds=None) -> None:
        """Joins the pairs that `holds` lets pass; pairs inside a component are never tried, and few at a time are."""
        for a, b in pairs:
            at, step = 0, 256
            while at < len(a):
                x, y = a[at : at + step], b[at : at + step]
                at, step = at + step, min(2 * step, _PIECE)
                apart = self.root(x) != self.root(y)
                x, y = x[apart], y[apart]
                if holds is not None and len(x):
                    ok = holds(x, y)
                    x, y = x[ok], y[ok]
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = self.one(i), self.one(j)
                    if p != q:
                        self.up[max(p, q)] = min(p, q)
                        self.joined.append((i, j))


def tree_links(group: np.ndarray, ids: np.ndarray, fps: np.ndarray, radius: int, filled: np.ndarray | None = None, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect the items of each group at most `radius` apart; with bins also so like that they're candidates, the likest first.

    Items of equal labels count as connected.
    """
    fps, order = fps.view(U64), np.lexsort((ids, group))
    group = group[order]
    first = _starts(group)
    size = np.repeat(np.diff(np.append(first, len(group))), np.diff(np.append(first, len(group))))
    order, group = order[size > 1], group[size > 1]
    forest = Forest(np.arange(len(order)) if labels is None else labels[order])
    if filled is None:
        forest.add(search(group, fps[order], radius))
    else:
        weak = []

        def strong(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            like = shared(filled[order[x]], filled[order[y]])
            if not weak and ((like >= ESTIMATE) & (like < STRONG)).any():
                weak.append(True)
            return like >= STRONG

        forest.add(search(group, fps[order], radius), strong)
        if weak:
            forest.add(search(group, fps[order], radius), lambda x, y: shared(filled[order[x]], filled[order[y]]) >= ESTIMATE)
    a, b = np.array(forest.joined, np.int64).reshape(-1, 2).T
    return ids[order[a]], ids[order[b]]


def _columns(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    """Longs of the named columns; `bins` as rows of bytes."""
    out = []
    for c in names:
        column = batch.column(batch.schema.get_field_index(c))
        out.append(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS) if c == "bins" else column.to_numpy() if isinstance(batch, pa.Table) else column.to_numpy(zero_copy_only=False))
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def cells(members: DataFrame, room: int) -> DataFrame:
    """Members (key, id, label, size, ...) in cells (column cell) of about 2 * room, so that any two of a key with different labels meet in one.

    All but those of a key's largest label are queries: they meet each of the
    key's parts.  So a key of one label gives no cells, and one with few others
    few; what it takes grows with the queries times the parts.
    """
    by = members.groupBy("key", "label").agg(F.sum("size").alias("size"))
    keys = by.groupBy("key").agg(F.sum("size").alias("all"), F.max(F.struct("size", "label")).alias("most")).where(F.col("all") > F.col("most.size"))
    number = lambda c: F.ceil(c / F.lit(room)).cast("long")
    keys = keys.select("key", F.col("most.label").alias("__most"), number(F.col("all")).alias("__parts"), number(F.col("all") - F.col("most.size")).alias("__asks"))
    dealt = salted_join(members, keys, "key", "id").withColumns({"__part": F.pmod(F.xxhash64(F.lit(1), "id"), "__parts"), "__ask": F.pmod(F.xxhash64(F.lit(2), "id"), "__asks")})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = dealt.withColumn("__ask", each("__asks"))
    asking = dealt.where(F.col("label") != F.col("__most")).withColumn("__held", F.col("__part")).withColumn("__part", each("__parts")).where("__part != __held").drop("__held")
    names = [c for c in members.columns if c != "key"]
    return held.unionByName(asking).select(F.xxhash64("key", "__part", "__ask").alias("cell"), *names)


def meet(points: DataFrame, radius: int, sketched: bool = False, room: int = ROOM) -> DataFrame:
    """a, b: links between points (id, fp, keys: the shards that an id belongs to, and bins if `sketched`) that connect all which meet in a shard and are near."""
    names = ["id", "fp", *(["bins"] if sketched else [])]
    ddl = "id long, fp long" + (", bins binary" if sketched else "")
    counted = points.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > room)
    total = points.agg(F.sum(F.size("keys"))).first()[0] or 0
    large = sorted(map(tuple, counted.where(F.col("n") > max(room, total // MOST_DEALT)).collect()))  # so at most MOST_DEALT
    hot, parts = (np.array([r[k] for r in large], np.int64) for k in (0, 1))
    parts = -(-parts // room)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            lists = b.column(b.schema.get_field_index("keys"))
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ids = b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                salt = mix(ids[row].view(U64) ^ mix(keys.view(U64))) % parts[at].astype(U64)
                keys = np.where(hot[at] == keys, mix(keys.view(U64) + salt * U64(0x9E3779B97F4A7C15)).view(np.int64), keys)
            for k in range(0, len(row), 10_000):
                some = b.take(pa.array(row[k : k + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 10_000]), *[some.column(some.schema.get_field_index(c)) for c in names]], ["key", *names])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            end = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1]))  # the last shard may go on
            held[:] = [] if last else [[x[end:] for x in columns]]
            if end:
                yield _pairs(*tree_links(*[x[:end] for x in columns[:3]], radius, columns[3][:end] if sketched else None))

        for b in released(batches):
            if b.num_rows:
                held.append(_columns(b, "key", *names))
                size += b.num_rows
                if size > _HELD:
                    yield from out(False)
                    size = len(held[0][0])
        if held:
            yield from out(True)

    tasks = max(scan_partitions(points), total // 50_000)
    found = points.select("keys", *names).mapInArrow(dealt, f"key long, {ddl}").repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long").distinct()
    if not len(hot):
        return found
    found = checkpointed(found)
    again = points.select(F.explode("keys").alias("key"), *names).join(F.broadcast(points.sparkSession.createDataFrame([(k,) for k, _ in large], "key long")), "key")
    labels = components(found)
    members = again.join(labels, F.col("id") == F.col("node"), "left").select("key", *names, F.coalesce("root", "id").alias("label"), F.lit(1).alias("size"))

    def rest(one: pa.Table) -> pa.Table:
        ids, labels, fps, *filled = _columns(one, "id", "label", *names[1:])
        return pa.Table.from_batches([_pairs(*tree_links(np.zeros(len(ids), np.int64), ids, fps, radius, filled[0] if sketched else None, labels))])

    return found.union(cells(members, room).groupBy("cell").applyInArrow(rest, "a long, b long")).distinct()


def links(distinct: DataFrame, radius: int = RADIUS, room: int = ROOM) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at most `radius` (up to 2) bits apart, enough to connect each component."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("one of three blocks agrees only within two bits")
    keys = [F.xxhash64(F.lit(k), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1))) for k, (at, n) in enumerate(_BLOCKS)]
    return meet(distinct.select("fp", F.col("fp").alias("id"), F.array(*keys).alias("keys")), radius, room=room)


def components(edges: DataFrame, files: int = 1, hot: int = HOT) -> DataFrame:
    """node, root (the smallest node of its component) of every node of the edges (a, b) but the roots.

    Large-star and small-star steps in turn: each links a node's neighbours to
    the smallest of them.  Once a node has over `hot` edges, minima come to the
    edges by a join that deals the edges of one node to many tasks.  The first
    table of edges goes to so many files, later ones to one for each half
    million edges.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct().coalesce(files))

    def state(df: DataFrame) -> tuple:
        """Edges, a sum of their hashes, the most edges of a node."""
        ends = df.select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64("a", "b").cast("decimal(20,0)").alias("hash"))
        each = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("hash").alias("hash"))
        return tuple(each.agg(F.coalesce(F.sum("n"), F.lit(0)) / 2, F.sum("hash"), F.max("n")).first())

    def lowest(df: DataFrame, low: DataFrame, most: int) -> DataFrame:
        return salted_join(df, low, "a", "b") if most > hot else df.join(low, "a")

    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = lowest(both, low, before[2]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = lowest(large, low, before[2]).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.*").where("a != b").distinct().coalesce(1 + int(before[0]) // 500_000))
        after = state(edges)
        if after[:2] == before[:2]:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) of every row.

    Texts without words, null ones too, have the fingerprint zero and are
    linked like any other; each of repeated rows gives a row; a null doc_id
    never becomes a component's id unless there's no other; an empty table
    gives an empty result.
    """
    own = compacted(fingerprints(docs, id_col, text_col, words))
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), radius), scan_partitions(own))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def bins(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(text, bin): eight bits of the lowest hash of each bin that a text's shingles fall into, from 1; 0 for none."""
    low = np.full((len(sizes), BINS), np.iinfo(U64).max, U64)
    mixed = mix(hashes ^ U64(0x5851F42D4C957F2D))
    np.minimum.at(low.ravel(), np.repeat(np.arange(len(sizes)), sizes) * BINS + (mixed & U64(BINS - 1)).astype(np.int64), mixed >> U64(8))
    return np.where(low == np.iinfo(U64).max, 0, low % U64(255) + U64(1)).astype(np.uint8)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of the shingle sets behind rows of bins: equal ones of those that either fills."""
    either = np.count_nonzero(a | b, axis=1)
    same = np.count_nonzero((a == b) & (a != 0), axis=1)
    return same / np.maximum(either, 1)


def _sketches(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, hash, text): id (a hash of the text's words, A-Z lower-cased), the SimHash of its shingles, the keys of its anchors and its bins."""
    seeds = mix(np.arange(1, 2 * ANCHORS + 1, dtype=U64) * U64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, many in chunked(batches, "doc_id", "hash", "text", limit=1 << 19):
            digests = [shingle_digests(x, SHINGLE) for x in many]
            fps = simhashes(digests)
            same = np.array([xxhash.xxh64_intdigest(b" ".join(x.encode().translate(LOWER).split())) for x in many], U64)
            sizes = np.array([max(1, len(x)) for x in digests])
            flat = np.frombuffer(b"".join(b"".join(x) or bytes(8) for x in digests), ">u8").astype(U64)
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            lowest = [np.minimum.reduceat(mix(flat ^ s), start) for s in seeds]
            keys = np.stack([mix(lowest[2 * k] ^ mix(lowest[2 * k + 1]) + U64(k)) for k in range(ANCHORS)], axis=1)
            columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(same.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(keys.view(np.int64).tolist(), pa.list_(pa.int64())), pa.array([b.tobytes() for b in bins(flat, sizes)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "id", "fp", "keys", "bins"])

    return rows.mapInArrow(run, "doc_id long, hash long, id long, fp long, keys array<long>, bins binary")


def similar(sets: list[np.ndarray], labels: np.ndarray | None = None) -> np.ndarray:
    """The first of each set's component, sets being linked that share `SIMILARITY` or more of all their items (distinct, sorted).

    A set is held against earlier ones in blocks, and never against one that is
    in its component already, as sets of equal labels are from the start.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    items, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(sizes)])
    percent = round(100 * SIMILARITY)
    forest, has = Forest(np.arange(len(sets)) if labels is None else labels), np.zeros(len(items), bool)
    for i in range(1, len(sets)):
        own = flat[start[i] : start[i + 1]]
        has[own] = True
        rest = np.flatnonzero(100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i]))
        rest = rest[forest.root(rest) != forest.one(i)]
        block = 4
        while len(rest):
            now, rest = rest[:block], rest[block:]
            many = np.concatenate([has[flat[start[j] : start[j + 1]]] for j in now])
            both = np.add.reduceat(many, np.concatenate([[0], np.cumsum(sizes[now])[:-1]]), dtype=np.int64)
            near = now[100 * both >= percent * (sizes[now] + sizes[i] - both)]
            if len(near):
                forest.add(iter([(near, np.full(len(near), i))]))
                rest = rest[forest.root(rest) != forest.one(i)]
            block = min(4 * block, 1024)
        has[own] = False
    return forest.root(np.arange(len(sets)))


def _sets(rows: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, shingles (their hashes, distinct and sorted) of the nodes; one text of each class is fetched from rows (doc_id, hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, many in chunked(batches, "id", "text", limit=1 << 19):
            sets = [np.unique(np.frombuffer(b"".join(shingle_digests(x, SHINGLE)) or bytes(8), "<i8")) for x in many]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    members = classes.join(nodes, "id", "left_semi").select("id", "least.doc_id", "least.hash")
    return rows.join(members, ["doc_id", "hash"]).select("id", "text").dropDuplicates(["id"]).mapInArrow(run, "id long, shingles array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, room: int = SET_ROOM) -> DataFrame:
    """node, root: components of the sets (id, shingles) that share `SIMILARITY`; edges (a, b) name the candidates.

    Each edge is tried.  Where one fails, other pairs of its candidates' component
    may hold; so if true edges don't connect its ends, the members on both sides
    meet in cells of bounded size, and those that no true edge connects are tried
    against each other.
    """

    def rest(one: pa.Table) -> pa.Table:
        labels = one["label"].to_numpy()
        first = similar([x.values.to_numpy(zero_copy_only=False) for x in one["shingles"]], labels)
        return pa.Table.from_batches([_pairs(labels, labels[first])])

    left = edges.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("own")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("other")), "b")
    same = F.size(F.array_intersect("own", "other"))
    ok = 100 * same >= round(100 * SIMILARITY) * (F.size("own") + F.size("other") - same)
    verdicts = checkpointed(both.select("a", "b", ok.alias("ok")).coalesce(scan_partitions(edges)))
    roots = components(verdicts.where("ok").select("a", "b"))
    label = lambda name, node: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    open_ = verdicts.where("not ok").join(label("x", "a"), "a", "left").join(label("y", "b"), "b", "left")
    open_ = checkpointed(open_.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct().coalesce(1))
    if not open_.limit(1).count():
        return roots
    groups = components(open_)
    groups = groups.select(F.col("node").alias("label"), F.col("root").alias("key")).union(groups.select("root", "root").distinct())
    nodes = groups.join(roots, groups.label == roots.root).select("key", "label", F.col("node").alias("id")).union(groups.select("key", "label", F.col("label").alias("id")))
    members = nodes.join(sets, "id").select("key", "id", "label", F.size("shingles").alias("size"), "shingles")
    more = components(cells(members, room).groupBy("cell").applyInArrow(rest, "a long, b long"))
    more = more.select(F.col("node").alias("root"), F.col("root").alias("final"))
    moved = roots.join(more, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return moved.union(more.select(F.col("root").alias("node"), F.col("final").alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies left, the one with the smallest doc_id.

    Texts are near copies if their sets of five-word shingles (A-Z lower-cased)
    share 0.8 or more.  Fingerprints of such texts differ in some eleven bits,
    far beyond what blocks of bits can find; so texts meet that have the same
    lowest shingle hashes under two of twenty seeds (a pair at 0.8 is missed
    once in 30,000), BK-trees over SimHashes find the neighbours in each such
    shard, and a sketch of 256 bins (its error is about 0.02) leaves out those
    that share less than 0.68 by it.  What is left only names candidates: their
    whole shingle sets are fetched by id, and only pairs that share 0.8 of them
    are linked (`confirmed`).  Exact copies, null or empty texts among them,
    count once beforehand.  Texts without words are copies of each other.  Rows
    repeated with their doc_id leave one.  An empty table stays empty.
    """
    key, hashed, number = unused(docs, "id", "hash", "number")
    marked = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), hashed: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    rows = marked.select(F.col(key).alias("doc_id"), F.col(hashed).alias("hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    first = [F.first(c).alias(c) for c in ("fp", "keys", "bins")]
    files = max(1, scan_partitions(rows) // 4)
    classes = checkpointed(_sketches(rows).groupBy("id").agg(F.min(F.struct("doc_id", "hash")).alias("least"), *first).coalesce(files))
    edges = checkpointed(meet(classes.select("id", "fp", "keys", "bins"), WIDE_RADIUS, True).coalesce(files))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    linked = confirmed(edges, checkpointed(_sets(rows, classes, nodes).coalesce(files)))
    rooted = classes.select("id", "least").join(linked, classes.id == linked.node, "left").select("least", F.coalesce("root", "id").alias("root"))
    keepers = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias(key), F.col("least.hash").alias(hashed))
    kept = marked.join(keepers, [key, hashed], "left_semi")
    one = W.partitionBy(key, hashed).orderBy(F.lit(0))
    return kept.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
