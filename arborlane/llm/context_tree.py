"""Operator 2, language-model scoring: context-tree weighting over bytes.

Texts are scored as their words, A-Z lower-cased, one space apart, and an end.
Each byte is eight binary decisions; a decision in a context of the last d
bytes, d from 0 to 5, has a Krichevsky-Trofimov estimate from its counts in
training text.  A context is either a leaf or splits by the byte before it,
each with half the weight, recursively; the posterior of that mixture over all
trees, after the training counts, gives each decision's probability, the mean of
the estimates of all depths on its path.  Logarithms add up to the code length.

The model grows with the corpus, so it is never broadcast or collected.  Its
counts lie in shards by the last two bytes of the context (whole subtrees) and,
for the unigram base score, by word.  Documents meet in blocks of a few MB;
each block asks each shard once for the distinct n-grams and words that it
holds, and gets numbers back in the same order.  Only the mixture's two top
levels, 257 contexts of 255 decisions whatever the corpus, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Words, checkpointed, chunked, grams, mix, partitions_by_bytes, read, sum_by

DEPTH = 5
HELD_FOLD, FOLDS = 0, 10
#: Bytes of text in a block; blocks for each shard, least and most shards.
BLOCK_BYTES, BLOCKS_PER_SHARD, LEAST_SHARDS, MOST_SHARDS = 12 << 20, 4, 16, 16_384
#: Distinct keys that a task gathers before it passes them on.
GATHERED = 3_000_000
_NONE = -(2**63)
_EMPTY = np.zeros(0, U64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5, by shifting to x >= 10 and Stirling's series."""
    x = x.astype(np.float64)
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        shift -= np.log(np.where(small, x, 1.0))
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def merged(keys: list[np.ndarray], counts: list[np.ndarray] | None = None):
    """Distinct keys, sorted, with their sums of counts if given."""
    flat = np.concatenate(keys) if keys else _EMPTY
    if counts is None:
        return np.unique(flat)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], np.concatenate(counts)[order] if counts else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    return flat[first], np.add.reduceat(n, first) if len(first) else n


class Subtrees:
    """The weighted nodes of depth 2 to 5 below some contexts; key: the six bytes of context and next byte, the oldest first."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[tuple[np.ndarray, ...]] = []  # from depth 5 up to 2: node, stop, estimate of a one
        below: tuple[np.ndarray, np.ndarray] | None = None
        for depth in range(DEPTH, 1, -1):
            node, zeros, ones = decisions(*merged([keys & U64((1 << 8 * (depth + 1)) - 1)], [counts]))
            stop, log_w = weighted(node, zeros, ones, below)
            self.levels.append((node, stop, (ones + 0.5) / (zeros + ones + 1.0)))
            parent = node & U64((1 << 8 * depth) - 1)
            below = merged([parent], [log_w])
            self.zeros, self.ones = merged([parent], [zeros])[1], merged([parent], [ones])[1]
        self.above, self.log_w = below if below is not None else (_EMPTY, np.zeros(0))

    def log10(self, keys: np.ndarray, top: Top) -> np.ndarray:
        """log10 of the probability of each key's last byte in the context of the others."""
        total = np.zeros(len(keys))
        byte, node = (keys & U64(255)).astype(np.int64), np.ones(len(keys), np.int64)
        context = keys >> U64(8)
        for bit in range(7, -1, -1):
            one = byte >> bit & 1
            p = np.full(len(keys), 0.5)
            for (known, stop, estimate), depth in zip(self.levels, range(DEPTH, 1, -1), strict=True):
                if len(known):
                    wanted = (context & U64((1 << 8 * depth) - 1)) << U64(8) | node.astype(U64)
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    p = np.where(known[at] == wanted, stop[at] * estimate[at] + (1 - stop[at]) * p, p)
            p = top.mixed(((context & U64(255)) << U64(8)).astype(np.int64) | node, p)
            total += np.log10(np.where(one == 1, p, 1 - p))
            node = node * 2 + one
        return total


def decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node (context * 256 + the bits so far, after a leading 1), zeros and ones, of keys (context * 256 + byte)."""
    context, byte = keys & ~U64(255), (keys & U64(255)).astype(np.int64)
    nodes, zeros, ones = [], [], []
    at = np.ones(len(keys), np.int64)
    for bit in range(7, -1, -1):
        one = byte >> bit & 1
        nodes.append(context | at.astype(U64))
        zeros.append(counts * (1 - one))
        ones.append(counts * one)
        at = at * 2 + one
    node, z = merged(nodes, zeros)
    return node, z, merged(nodes, ones)[1]


def weighted(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The posterior that each node is a leaf, and ln of its weighted probability; below: sums of the children's, of the same nodes."""
    estimate = log_kt(zeros, ones)
    if below is None:
        return np.ones(len(node)), estimate
    log_w = np.log(0.5) + np.logaddexp(estimate, below[1])
    return np.exp(np.log(0.5) + estimate - log_w), log_w


class Top:
    """The mixture's depths 1 and 0, from sums over the nodes of depth 2: node (byte of context * 256 + bits so far), ln weights, zeros, ones."""

    def __init__(self, node: np.ndarray, log_w: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        order = np.argsort(node)
        node, log_w, zeros, ones = (x[order] for x in (node, log_w, zeros, ones))
        stop, own = weighted(node, zeros, ones, (node, log_w))
        self.stop1, self.one1 = np.ones(1 << 16), np.full(1 << 16, 0.5)
        self.stop1[node], self.one1[node] = stop, (ones + 0.5) / (zeros + ones + 1.0)
        root = node & 255
        sums = [np.bincount(root, weights=x, minlength=256) for x in (own, zeros, ones)]
        self.stop0 = weighted(np.arange(256), sums[1], sums[2], (root, sums[0]))[0]
        self.one0 = (sums[2] + 0.5) / (sums[1] + sums[2] + 1.0)

    def mixed(self, node: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        p = self.stop1[node] * self.one1[node] + (1 - self.stop1[node]) * deeper
        root = node & 255
        return self.stop0[root] * self.one0[root] + (1 - self.stop0[root]) * p


def canonical(many: list[str]) -> list[bytes]:
    """The words, A-Z lower-cased, one space apart."""
    return [b" ".join(x.encode("utf-8").translate(LOWER).split()) for x in many]


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(33)) % U64(shards)).astype(np.int64)


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix((keys >> U64(8)) & U64(0xFFFF)) % U64(shards)).astype(np.int64)


def by_shard(keys: np.ndarray, where: np.ndarray, shards: int) -> Iterator[np.ndarray]:
    """For each shard the places of its keys, in order."""
    order = np.argsort(where, kind="stable")
    yield from np.split(order, np.searchsorted(where[order], np.arange(1, shards)))


def _binary(arrays: list[np.ndarray], kind: str) -> pa.Array:
    return pa.array([x.astype(kind).tobytes() for x in arrays], pa.binary())


COUNTS = "shard int, words binary, word_counts binary, grams binary, gram_counts binary, n_words long, n_docs long"
_COUNTS = [c.split()[0] for c in COUNTS.split(", ")]


def _partial_counts(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        n_words = n_docs = size = 0

        def out() -> pa.RecordBatch:
            words, grams_ = merged(held[0], held[1]), merged(held[2], held[3])
            parts = [list(by_shard(k[0], where(k[0], shards), shards)) for k, where in ((words, word_shard), (grams_, gram_shard))]
            rest = [pa.array([n_words] + [0] * (shards - 1), pa.int64()), pa.array([n_docs] + [0] * (shards - 1), pa.int64())]
            columns = [_binary([k[i][p] for p in part], kind) for k, part in zip((words, grams_), parts, strict=True) for i, kind in ((0, "<u8"), (1, "<i8"))]
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), *columns, *rest], _COUNTS)

        for (many,) in chunked(batches, "text"):
            encoded = canonical(many)
            words = Words(encoded)
            for k, keys in ((0, words.hash), (2, grams(encoded, DEPTH + 1)[0])):
                some, n = np.unique(keys, return_counts=True)
                held[k].append(some), held[k + 1].append(n)
                size += len(some)
            n_words, n_docs = n_words + len(words.start), n_docs + len(many)
            if size > GATHERED:
                for k in (0, 2):
                    some, n = merged(held[k], held[k + 1])
                    held[k], held[k + 1] = [some], [n]
                size = len(held[0][0]) + len(held[2][0])
                if size > GATHERED // 2:
                    yield out()
                    held = [[], [], [], []]
                    n_words = n_docs = size = 0
        if n_docs:
            yield out()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts, sorted by shard, to a row for each shard."""
    now, held, totals, size = None, [[], [], [], []], [0, 0], 0

    def out() -> pa.RecordBatch:
        words, grams_ = merged(held[0], held[1]), merged(held[2], held[3])
        columns = [_binary([x], kind) for k in (words, grams_) for x, kind in zip(k, ("<u8", "<i8"), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *columns, pa.array([totals[0]], pa.int64()), pa.array([totals[1]], pa.int64())], _COUNTS)

    for b in batches:
        shard, n_words, n_docs = (b.column(k).to_pylist() for k in (0, 5, 6))
        for i in range(b.num_rows):
            if shard[i] != now:
                if now is not None:
                    yield out()
                now, held, totals, size = shard[i], [[], [], [], []], [0, 0], 0
            for k in range(4):  # views of the batch, no copies
                held[k].append(np.frombuffer(b.column(1 + k)[i].as_buffer(), "<u8" if k % 2 == 0 else "<i8"))
            size += held[0][-1].nbytes + held[2][-1].nbytes
            totals = [totals[0] + n_words[i], totals[1] + n_docs[i]]
            if size > 16 * GATHERED:
                for k in (0, 2):
                    some, n = merged(held[k], held[k + 1])
                    held[k], held[k + 1] = [some], [n]
                size = 0
    if now is not None:
        yield out()


def train(texts: DataFrame, shards: int) -> DataFrame:
    """The counts of all rows (column text) in a row for each shard, checkpointed; a shard is a task."""
    partial = texts.mapInArrow(_partial_counts(shards), COUNTS)
    return checkpointed(partial.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_summed, COUNTS))


def top_levels(model: DataFrame) -> Top:
    """From at most 65,280 sums, whatever the corpus; decimals, so that the order of adding up doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = Subtrees(np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8"))
                # `above` are contexts of one byte: the sums over the depth-2 nodes below them
                yield pa.RecordBatch.from_arrays([pa.array(own.above.astype(np.int64)), pa.array(own.log_w), pa.array(own.zeros.astype(np.int64)), pa.array(own.ones.astype(np.int64))], ["node", "log_w", "zeros", "ones"])

    sums = model.select("grams", "gram_counts").mapInArrow(run, "node long, log_w double, zeros long, ones long").groupBy("node").agg(F.sum(F.col("log_w").cast("decimal(38,12)")).cast("double").alias("log_w"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    return Top(*(sums[c].to_numpy() for c in ("node", "log_w", "zeros", "ones")))


ASKED = "shard int, kind int, block long, words binary, word_counts binary, grams binary, gram_counts binary"


def _requests(shards: int):
    """Rows (block, ..., text) sorted by block to a row for each block and shard with the distinct keys that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        words: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            w, g = merged(words), merged(keys)
            columns = [_binary([k[p] for p in by_shard(k, where(k, shards), shards)], "<u8") for k, where in ((w, word_shard), (g, gram_shard))]
            none = pa.array([None] * shards, pa.binary())
            words.clear(), keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([1] * shards, pa.int32()), pa.array([now] * shards, pa.int64()), columns[0], none, columns[1], none], [c.split()[0] for c in ASKED.split(", ")])

        for blocks, many in chunked(batches, "block", "text"):
            edge = [0, *[i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]], len(blocks)]
            for a, b in zip(edge, edge[1:], strict=False):
                if blocks[a] != now:
                    if now is not None:
                        yield out()
                    now = blocks[a]
                encoded = canonical(many[a:b])
                words.append(np.unique(Words(encoded).hash))
                keys.append(np.unique(grams(encoded, DEPTH + 1)[0]))
        if now is not None:
            yield out()

    return run


def _answers(top: Top):
    """Rows of ASKED, sorted by shard with each model shard first, to the numbers that blocks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts, keys, logs, trees = None, _EMPTY, np.zeros(0, np.int64), _EMPTY, np.zeros(0), Subtrees(_EMPTY, np.zeros(0, np.int64))
        for b in batches:
            for shard, kind, block, w, wc, g, gc in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard != now:
                    own = (w, wc, g, gc) if kind == 0 else (b"",) * 4
                    words, counts, keys, n = (np.frombuffer(x, t) for x, t in zip(own, ("<u8", "<i8", "<u8", "<i8"), strict=True))
                    now, trees = shard, Subtrees(keys, n)
                    logs = trees.log10(keys, top)
                if kind == 0:
                    continue
                asked = np.frombuffer(w, "<u8")
                c = np.zeros(len(asked), np.int64)
                if len(words):
                    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                    c = np.where(words[at] == asked, counts[at], 0)
                asked = np.frombuffer(g, "<u8")
                p = np.zeros(len(asked))
                known = np.zeros(len(asked), bool)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                    known = keys[at] == asked
                    p[known] = logs[at[known]]
                p[~known] = trees.log10(asked[~known], top)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([shard], pa.int32()), _binary([c], "<i8"), _binary([p], "<f8")], ["block", "shard", "counts", "logs"])

    return run


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _scored(shards: int, n_words: int, n_docs: int, distinct: int):
    tokens = n_words + n_docs
    per_token = np.log10(tokens + 0.1 * (distinct + bool(n_docs) + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, held, many = (docs.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
        own = dict(zip(answers.column("shard").to_pylist(), zip(answers.column("counts").to_pylist(), answers.column("logs").to_pylist(), strict=True), strict=True))
        chunks, size, begin = [], 0, 0
        for i, x in enumerate(many):
            size += len(x) + 8
            if size > 2 << 20 or i == len(many) - 1:
                encoded = canonical(many[begin : i + 1])
                words = Words(encoded)
                w, w_at = np.unique(words.hash, return_inverse=True)
                keys, start = grams(encoded, DEPTH + 1)
                g, g_at = np.unique(keys, return_inverse=True)
                chunks.append((words.n_words, words.doc, w, w_at.astype(np.int32), g, g_at.astype(np.int32), start))
                size, begin = 0, i + 1
        tables = []
        for k, where, kind, part in ((2, word_shard, "<i8", 0), (4, gram_shard, "<f8", 1)):
            keys = merged([c[k] for c in chunks])
            values = np.zeros(len(keys))
            for shard, at in enumerate(by_shard(keys, where(keys, shards), shards)):
                if len(at):
                    values[at] = np.frombuffer(own[shard][part], kind)
            tables.append((keys, values))
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for n, doc, w, w_at, g, g_at, start in chunks:
            c = tables[0][1][np.searchsorted(tables[0][0], w)]
            out[0].append(n + 1)
            out[1].append(np.bincount(doc, weights=(c > 0)[w_at], minlength=len(n)) + bool(n_docs))
            out[2].append(np.bincount(doc, weights=np.log10(c + 0.1)[w_at], minlength=len(n)) + np.log10(n_docs + 0.1))
            out[3].append(sum_by(tables[1][1][np.searchsorted(tables[1][0], g)][g_at], start))
            out[4].append(np.diff(np.append(start, len(g_at))))
        n, known, base, score, n_bytes = (np.concatenate(x) if x else np.zeros(0) for x in out)
        whole = lambda x: pa.array(x.astype(np.int64))
        ids = pa.array([None if i == _NONE else i for i in ids], pa.int64())
        return pa.Table.from_arrays([ids, pa.array(held, pa.bool_()), whole(n), whole(known), whole(np.full(len(n), tokens)), pa.array(base - n * per_token), pa.array(score), whole(n_bytes), pa.array(-score / np.log10(2) / np.maximum(n_bytes, 1))], [c.split()[0] for c in SCHEMA.split(", ")])

    return run


def fold(column):
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % FOLDS


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by models of the rows that are not held out.

    doc_id, held_out, n_tokens (words and an end), n_known (tokens that occur
    in training text), train_tokens, base_score (log10, unigrams), score (log10
    of the model's probability of the text), n_bytes (what the score codes:
    bytes and an end) and bits_per_byte (its code length by that).  A null text is empty and has the end alone; repeated
    rows each give a row (and count each in training); without training rows
    every decision is even; an empty table gives an empty result.
    """
    key = F.col(f"`{id_col}`")
    rows = docs.select(F.coalesce(key.cast("long"), F.lit(_NONE)).alias("doc_id"), (fold(key) == HELD_FOLD).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    blocks = partitions_by_bytes(rows, BLOCK_BYTES)
    shards = min(MOST_SHARDS, max(LEAST_SHARDS, blocks // BLOCKS_PER_SHARD))
    model = train(rows.where(~F.col("held_out")).select("text"), shards)
    n_words, n_docs, distinct = (int(x or 0) for x in model.agg(F.sum("n_words"), F.sum("n_docs"), F.sum(F.octet_length("words") / 8)).first())
    top = top_levels(model)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "held_out", "text").repartition(blocks, "block")
    asked = dealt.sortWithinPartitions("block").mapInArrow(_requests(shards), ASKED)
    kept = model.select("shard", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("block"), "words", "word_counts", "grams", "gram_counts")
    answers = kept.union(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "block").mapInArrow(_answers(top), "block long, shard int, counts binary, logs binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(shards, n_words, n_docs, distinct), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
