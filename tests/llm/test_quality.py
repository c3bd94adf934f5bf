import re
from collections import Counter

import numpy as np

from arborlane.llm import quality as q

from .cases import EDGE, edge, empty


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force():
    rng = np.random.default_rng(3)
    many = ["".join(rng.choice(list("ab é\n\t#|日"), rng.integers(0, 200))) for _ in range(300)] + [" ".join(rng.choice(["x", "yy"], 60)) for _ in range(50)] + ["same line\n" * 5, "\n \n \n"]
    assert list(zip(*[x.tolist() for x in q.rule_counts(many)], strict=True)) == [brute_counts(t) for t in many]


def model_of(many):
    keys, n = np.unique(q.grams([x.encode() for x in many], 4)[0], return_counts=True)
    keys = keys.astype(np.int64)
    top, tn = np.unique(q._slot(keys >> 8) * 256 + (keys & 255), return_inverse=True)
    return q.KneserNey((top, np.bincount(tn, weights=n)), np.unique(keys & 0xFFFFFF, return_counts=True))


def test_every_context_sums_to_one():
    model = model_of(["the cat sat on the mat", "a dog sat", "été", ""] * 3 + ["the end"])
    for context in (0x746865, 0x206361, 0xFFFFFF, 0x7A7A7A):
        assert abs(model.probability((context << 8) + np.arange(256)).sum() - 1) < 1e-5


def brute_probability(many, context, byte):
    """Modified Kneser-Ney by its definition, over dictionaries."""
    grams = Counter()
    for t in many:
        s = b"\xff" * 3 + t.encode() + b"\xff"
        grams.update(s[i : i + 4] for i in range(len(s) - 3))
    tables = [grams]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))
    p = 1 / 256
    for table, n in zip(tables[::-1], range(4), strict=True):
        c = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5
        d = [0] + [min(max(k + 1 - (k + 2) * y * c[k + 1] / c[k], 0.1), k + 1) if c[k] else 0.5 for k in range(3)]
        h = context[3 - n :] if n else b""
        own = {g: v for g, v in table.items() if g[:-1] == h}
        total = sum(own.values())
        if total:
            v = table.get(h + bytes([byte]), 0)
            p = (v - min(d[min(v, 3)], v)) / total + sum(min(d[min(x, 3)], x) for x in own.values()) / total * p
    return p


def test_probabilities_equal_the_definition():
    many = ["the cat sat on the mat", "a dog sat there then", "thou and thee", "", "mat cat"]
    model = model_of(many)
    for context, byte in [(b"the", 32), (b" ca", 116), (b"\xff\xff\xff", 116), (b"zqx", 97), (b"at ", 255), (b"qth", 101)]:
        key = np.array([int.from_bytes(context + bytes([byte]), "big")])
        assert np.isclose(model.probability(key)[0], brute_probability(many, context, byte), rtol=1e-5)


def test_edge_rows(spark):
    rows = q.rules(edge(spark)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=str)
    assert got == sorted(((d, *brute_counts(t)) for d, t, *_ in EDGE), key=str)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id != 5)
    assert q.rules(empty(spark)).count() == 0
    kept = q.keep_good(edge(spark))
    assert kept.columns == edge(spark).columns and q.keep_good(empty(spark)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = q.query(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        c = brute_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0]) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert {r.doc_id for r in q.keep_good(spark.read.parquet(f"{sf}/documents.parquet")).collect()} == kept


def test_bands_reject_noise_and_keep_prose(spark):
    rng = np.random.default_rng(8)
    stems = ["".join(rng.choice(list("aeioulnrst"), 4)) for _ in range(200)]
    rows = [(k, " ".join(rng.choice(stems, 120)), "xx") for k in range(300)]
    rows += [(1000 + k, " ".join("".join(rng.choice(list("QWZXJ#%&0123456789"), 5)) for _ in range(120)), "xx") for k in range(10)]
    got = {r.doc_id: r.kept for r in q.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[k] for k in range(300)) >= 299 and not any(got[1000 + k] for k in range(10))


def test_bands_reject_most_poor_documents_and_hardly_a_good_one(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    rows = q.query(spark, sf).where("not base_failed").join(labels, "doc_id").collect()
    poor, good = ([r for r in rows if r.quality == v] for v in (0, 1))
    assert sum(r.kept for r in poor) <= 0.25 * len(poor) and sum(r.kept for r in good) >= 0.99 * len(good)
    assert any(r.bits < r.lower for r in poor) and any(r.bits > r.upper for r in poor)


def test_no_two_contexts_or_languages_share_a_place(spark):
    contexts = np.arange(0, 1 << 24, 37)
    assert len(np.unique(q._slot(contexts))) == len(contexts)
    rng = np.random.default_rng(9)
    langs = [f"l{k}" for k in range(700)]  # more than the 512 places that they once shared
    scores = [(lang, False, float(x)) for k, lang in enumerate(langs) for x in k / 50 + rng.random(9)] + [(None, False, 77.0), ("", False, 3.0), ("gone", True, 1.0)]
    found = {r.place: r for r in q.bands(spark.createDataFrame(scores, "place string, base_failed boolean, level double")).collect()}
    assert set(found) == {*langs, None, ""}
    for lang in (None, "", *langs[::50]):
        bins = sorted(int(x * q.BINS // 1) for place, _, x in scores if place == lang)
        middle = bins[(len(bins) - 1) // 2]
        low, high = (sorted(abs(b - middle) for b in bins if side * (b - middle) >= 0) for side in (-1, 1))
        want = [max(q.LEAST_DEVIATION, 1.4826 * d[(len(d) - 1) // 2] / q.BINS) for d in (low, high)]
        assert np.allclose([found[lang].middle, found[lang].below, found[lang].above], [(middle + 0.5) / q.BINS, *want])


def test_many_languages_have_their_own_bands(spark, monkeypatch):
    rows = spark.createDataFrame([(k, " ".join(f"{chr(97 + k % 26)}w{j * (k % 26 + 1)}" for j in range(40)), f"l{k % 600}") for k in range(1200)], "doc_id long, text string, lang string")
    few = {r.doc_id: (r.lower, r.upper, r.kept) for r in q.rules(rows).collect()}
    monkeypatch.setattr(q, "BROADCAST", 10)
    assert {r.doc_id: (r.lower, r.upper, r.kept) for r in q.rules(rows).collect()} == few
