import hashlib
import random
from collections import Counter

import numpy as np

from arborlane.llm import fingerprints as fp

from .cases import EDGE, edge, empty


def test_order_and_incremental():
    assert fp.fingerprint("a b c\nd e f") == fp.fingerprint("d e f\na b c") != fp.fingerprint("a b c\nd e g")
    assert fp.add(fp.fingerprint("a b\nc"), fp.fingerprint("d e f g")) == fp.fingerprint("d e f g\na b\nc")
    assert fp.subtract(fp.fingerprint("d e f g\na b\nc"), fp.fingerprint("c")) == fp.fingerprint("a b\nd e f g")
    assert fp.fingerprint(None) == fp.fingerprint("") != fp.fingerprint("\n")


def test_batch_equals_one_by_one():
    many = [t or "" for _, t, *_ in EDGE]
    exact, lanes = fp.vectors(many)
    assert [fp.pack(*x) for x in zip(exact, lanes, strict=True)] == [fp.fingerprint(t) for t in many]


def test_likeness_follows_overlap():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000)]
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        a = words[:1000]
        b = a[: int(1000 * share)] + words[2000 : 3000 - int(1000 * share)]
        assert abs(fp.likeness(fp.fingerprint(" ".join(a)), fp.fingerprint(" ".join(b))) - share) < 0.2


def brute(rows):
    rows = sorted(((d if d is not None else fp._NONE, t or "") for d, t in rows), key=lambda x: (-x[0], x[1]))
    for i, (d, t) in enumerate(rows):
        n = len(t)
        nxt = rows[(i + 1) % len(rows)][1]
        edited = t[: n - n // 2] + nxt[: n // 2]
        f, e, x = fp.fingerprint(t), fp.fingerprint(edited), fp.fingerprint(nxt)
        yield None if d == fp._NONE else d, n, hashlib.sha256(edited.encode()).hexdigest(), f, e, fp.likeness(f, e), fp.likeness(f, x)


def check(got, rows):
    got, want = sorted(map(tuple, got), key=str), sorted(brute(rows), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want])


def test_edge_rows(spark):
    check(fp.fingerprints(edge(spark)).collect(), [(d, t) for d, t, *_ in EDGE])
    check(fp.fingerprints(edge(spark).where("doc_id = 5")).collect(), [(5, EDGE[5][1])])
    assert fp.fingerprints(empty(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = fp.query(spark, sf).collect()
    check(rows, docs)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.9


def test_hot_ids_are_cut_by_their_texts(spark):
    """A third of all rows without an id, a third of one id, some of them equal."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé日") for _ in range(rng.randint(0, 12)))
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(word() for _ in range(3)) if k % 5 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(fp.fingerprints(df).collect(), rows)
    parts, n = fp.with_next(df)
    sizes = Counter(r.part for r in parts.where("not copy").collect())
    assert n > 6 and sum(sizes.values()) == 600 and max(sizes.values()) < 200
    assert parts.where("copy").count() <= 6 * n
