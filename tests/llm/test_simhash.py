import random
import re

import numpy as np
import pytest
import xxhash

from arborlane.llm import simhash as sh

from .cases import EDGE, edge, empty


def brute_fp(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    least = {}
    for (d, _), k in zip(rows, label, strict=True):
        least[k] = min(x for x in (least.get(k), d) if x is not None) if d is not None or least.get(k) is not None else None
    return sorted(((d, f"{f:016x}", least[k]) for (d, _), f, k in zip(rows, fps, label, strict=True)), key=str)


@pytest.mark.parametrize("spread", [2, 6, 40])
def test_trees_find_all_pairs(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fps = np.array([int(base[k % 4]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, spread)).tolist())) for k in range(400)], np.uint64)
    group = np.sort(rng.integers(0, 6, 400))
    for radius in (0, 2, 9, 22):
        got = {(int(a), int(b)) for x, y in sh.search(group, fps, radius) for a, b in zip(x, y, strict=True)}
        want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius}
        assert got == want


def test_links_connect_all_within_two_bits(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in sh.components(sh.links(df)).collect()}
    label = {f: f for f in fps}
    for _ in range(70):
        for a in fps:
            for b in fps:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    assert {f: found.get(f, f) for f in fps} == label
    with pytest.raises(ValueError):
        sh.links(df, 3)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id a", "id + 1 b")
    assert {r.root for r in sh.components(edges).collect()} == {0}
    assert sh.components(edges.limit(0)).count() == 0
    star = edges.union(spark.range(300).selectExpr("id * 2 + 1000 a", "5 b"))
    assert {r.root for r in sh.components(star, hot=10).collect()} == {0} and sh.components(star, hot=10).count() == 500


def test_edge_rows(spark):
    rows = [tuple(r) for r in sh.near_duplicates(edge(spark)).collect()]
    assert sorted(rows, key=str) == brute([(d, t) for d, t, *_ in EDGE])
    assert sh.near_duplicates(empty(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, sh.query(spark, sf).collect()), key=str) == brute(docs)


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_keep_one(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, group = [], {}
    for g in range(30):
        base = [word() for _ in range(120)]
        for k in range(4):
            text = list(base)
            if k:
                text[rng.randrange(120)] = word()  # about 0.92 of the shingles stay
            group[len(rows)] = g
            rows.append((len(rows), " ".join(text), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == [4 * g for g in range(30)]


def test_keep_one_edge_rows(spark):
    kept = sh.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 1, 4, 5, 6, 7]
    assert sh.keep_one(empty(spark)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (12, 120, 5000):
        for share in (0.5, 0.8, 0.95):
            both = int(n * share)
            own = [rng.integers(0, 2**63, n - both, dtype=np.uint64) for _ in range(2)]
            common = rng.integers(0, 2**63, both, dtype=np.uint64)
            a, b = (sh.bins(np.concatenate([common, x]), np.array([n])) for x in own)
            assert abs(sh.shared(a, b)[0] - both / (2 * n - both)) < 0.1


def test_similar_equals_all_pairs():
    rng = np.random.default_rng(12)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[(k % 3) * 15 : (k % 3) * 15 + 22], rng.integers(14, 40))) for k in range(150)]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert 3 < len(set(want)) < 140 and sh.similar(sets).tolist() == want


def test_keep_one_links_from_0_8_on_exactly(spark):
    """Pairs of 250 shingles in all: 200 shared are near copies, 199 (of 250) are not."""
    rows, want = [], []
    for g in range(60):
        for shared in (200, 199):
            word = lambda k, g=g, shared=shared: f"w{g}x{shared}y{k}"
            first = [word(k) for k in range(shared + 4)]
            extra = 250 - shared
            a, b = first + [word(1000 + k) for k in range(extra // 2)], first + [word(2000 + k) for k in range(extra - extra // 2)]
            assert (len(shingles(" ".join(a)) & shingles(" ".join(b))), len(shingles(" ".join(a)) | shingles(" ".join(b)))) == (shared, 250)
            want += [len(rows)] if shared == 200 else [len(rows), len(rows) + 1]
            rows += [(len(rows), " ".join(a), "en"), (len(rows) + 1, " ".join(b), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in sh.keep_one(df).collect()) == want


def _labels(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def test_shards_in_parts_lose_no_link(spark):
    """One bit block is the same for all: each shard of it is dealt into many small parts."""
    rng = random.Random(5)
    fps = {(rng.getrandbits(42) << 22 | 77) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            f ^= 1 << rng.randrange(22, 64)
            fps.add(f)
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    found = {r.node: r.root for r in sh.components(sh.links(spark.createDataFrame([(f,) for f in fps], "fp long"), room=10)).collect()}
    near = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert [found.get(f, f) for f in fps] == [fps[k] for k in _labels(len(fps), near)]


def test_cells_bring_all_unlike_members_together(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(3), k, rng.choice([1, 1, 1, 1, 2, 3, k]), rng.randrange(1, 4)) for k in range(300)]
    own = {k: (key, label) for key, k, label, _ in rows}
    together = {}
    for r in sh.cells(spark.createDataFrame(rows, "key long, id long, label long, size long"), 40).collect():
        together.setdefault(r.cell, []).append(r.id)
    met = {(a, b) for x in together.values() for a in x for b in x}
    assert max(map(len, together.values())) < 100 and all(len(set(x)) == len(x) for x in together.values())
    assert not [(a, b) for a in own for b in own if own[a][0] == own[b][0] and own[a][1] != own[b][1] and (a, b) not in met]
    assert sh.cells(spark.createDataFrame([(1, 1, 9, 5), (1, 2, 9, 5)], "key long, id long, label long, size long"), 4).count() == 0


def test_confirmed_tries_other_pairs_where_an_edge_fails(spark):
    """A chain of sets, of which the candidates' edges name only some and wrong ones."""
    sets = [np.arange(k, k + 40, dtype="<u8") for k in range(0, 12, 4)] + [np.arange(100 + k, 140 + k, dtype="<u8") for k in (0, 30, 4)]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "id long, shingles array<long>")
    edges = spark.createDataFrame([(0, 2), (1, 2), (3, 4), (4, 5)], "a long, b long")
    for room in (1 << 20, 50):
        assert {r.node: r.root for r in sh.confirmed(edges, df, room).collect()} == {1: 0, 2: 0, 5: 3}


def test_keep_one_of_a_group_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(sh, "ROOM", 16)
    monkeypatch.setattr(sh, "MOST_DEALT", 1000)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(200):
        text = list(base)
        text[rng.randrange(120)] = word()
        rows.append((k, " ".join(text if k % 20 else [word() for _ in range(60)]), k))
    df = spark.createDataFrame(rows, "doc_id long, text string, id long").selectExpr("*", "'x' AS `_id`", "'y' AS number", "'z' AS hash")
    kept = sh.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.id, r._id) for r in kept.collect()) == sorted([(1, 1, "x"), *[(k, k, "x") for k in range(0, 200, 20)]])
