import math
import re
import zlib
from collections import Counter

import numpy as np

from arborlane.llm import context_tree as ct

from .cases import EDGE, edge, empty


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Tree:
    """Context-tree weighting by recursion over explicit nodes."""

    def __init__(self, streams, depth=ct.DEPTH):
        self.depth, self.n, self.children, self.memo = depth, {}, {}, {}
        for s in streams:
            for context, byte in symbols(s):
                for d in range(depth + 1):
                    c, node = context[len(context) - d :], 1
                    if d:
                        self.children.setdefault(c[1:], set()).add(c)
                    for bit in range(7, -1, -1):
                        one = byte >> bit & 1
                        self.n.setdefault((c, node), [0, 0])[one] += 1
                        node = node * 2 + one

    def kt(self, c, node):
        a, b = self.n.get((c, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, c, node):
        if (c, node) not in self.memo:
            own = self.kt(c, node)
            if len(c) < self.depth:
                own = math.log(0.5) + np.logaddexp(own, sum(self.weighted(x, node) for x in self.children.get(c, ()) if (x, node) in self.n))
            self.memo[c, node] = own
        return self.memo[c, node]

    def one(self, context, node, d=0):
        c = context[len(context) - d :]
        a, b = self.n.get((c, node), (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        if not a + b:
            return 0.5
        stop = math.exp(math.log(0.5) + self.kt(c, node) - self.weighted(c, node))
        return stop * estimate + (1 - stop) * self.one(context, node, d + 1)

    def log10(self, s):
        total = 0.0
        for context, byte in symbols(s):
            node = 1
            for bit in range(7, -1, -1):
                bit_is_one, p = byte >> bit & 1, self.one(context, node)
                total += math.log10(p if bit_is_one else 1 - p)
                node = node * 2 + bit_is_one
        return total


def symbols(stream):
    padded = b"\xff" * 5 + stream + b"\xff"
    return [(padded[k - 5 : k], padded[k]) for k in range(5, len(padded))]


def brute(rows):
    tokens = [(d, [*words_of(t), None]) for d, t in rows]
    train = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(train.values()), len(train)
    tree = Tree([" ".join(words_of(t)).encode() for d, t in rows if not held(d)])
    for (d, ws), (_, t) in zip(tokens, rows, strict=True):
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        yield d, held(d), len(ws), sum(train[w] > 0 for w in ws), n, base, tree.log10(" ".join(words_of(t)).encode())


def check(got, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    want = sorted(brute(rows), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-5)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e9])
    assert np.allclose(ct.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_decisions_in_a_context_sum_to_one():
    rng = np.random.default_rng(1)
    keys, n = np.unique(rng.integers(97, 100, (4000, 6)) @ (256 ** np.arange(6)), return_counts=True)
    tree = ct.Subtrees(keys.astype(np.uint64), n)
    top = ct.Top(tree.above.astype(np.int64), tree.log_w, tree.zeros, tree.ones)
    for context in (0x6162636162, 0x6100000062, 0):
        p = 10 ** tree.log10((np.uint64(context << 8) + np.arange(256, dtype=np.uint64)), top)
        assert abs(p.sum() - 1) < 1e-9


def test_small_table_against_recursion(spark):
    base = ["The cat sat on the mat", "the  dog\nsat", "", None, "a", "zz top é", "the cat sat on the mat"]
    rows = [(k, base[k % len(base)]) for k in range(40)]
    check(ct.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_edge_rows(spark):
    rows = [(d, t) for d, t, *_ in EDGE if t is None or len(t) < 9000]
    check(ct.score(edge(spark).where("text is null or length(text) < 9000")).collect(), rows)
    assert ct.score(edge(spark)).count() == len(EDGE)
    assert ct.score(empty(spark)).count() == 0


def test_without_training_rows_all_is_even(spark):
    ids = [k for k in range(300) if held(k)][:3]
    for r in ct.score(spark.createDataFrame([(k, "ab") for k in ids], "doc_id long, text string")).collect():
        assert abs(r.score - 3 * 8 * math.log10(0.5)) < 1e-6 and r.train_tokens == 0 and abs(r.base_score) < 1e-9


def test_more_blocks_and_shards_change_nothing(spark, sf, monkeypatch):
    def rows():
        return sorted((r.doc_id, r.n_known, round(r.base_score, 4), round(r.score, 3)) for r in ct.query(spark, sf).collect())

    one = rows()
    monkeypatch.setattr(ct, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(ct, "BLOCKS_PER_SHARD", 1)
    assert [x[:3] for x in rows()] == [x[:3] for x in one]


def test_query_learns(spark, sf):
    rows = ct.query(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    out = [r for r in rows if r.held_out]
    assert sum(-r.score for r in out) / sum(r.n_bytes for r in out) / math.log10(2) < 3


def test_scores_do_not_hang_on_how_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, other = ({r.doc_id: (r.score, r.base_score, r.bits_per_byte) for r in ct.score(df).collect()} for df in (docs, docs.repartition(5)))
    assert one == other
