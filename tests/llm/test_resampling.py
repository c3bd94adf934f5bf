import numpy as np
from pyspark.sql import functions as F

from arborlane.llm import resampling as rs

from .cases import EDGE, edge, empty


def labels(spark, rows=((1, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def brute_weights(many, good):
    counts = np.zeros((2, len(rs.SIZES), rs.PLACES))
    for t, g in zip(many, good, strict=True):
        for k, n in enumerate(rs.SIZES):
            for p in rs.places([t.encode()], n)[0]:
                counts[0, k, p] += 1
                counts[1, k, p] += g
    probability = (counts + rs.SMOOTHING) / (counts + rs.SMOOTHING).sum(axis=2, keepdims=True)
    out = []
    for t in many:
        where = [rs.places([t.encode()], n)[0] for n in rs.SIZES]
        total = sum(np.log(probability[1, k, p] / probability[0, k, p]) for k, ps in enumerate(where) for p in ps) / len(rs.SIZES)
        out.append(total * min(1, rs.EVIDENCE / len(where[-1])))
    return out


def test_weights_equal_brute_force(spark):
    rows = [(k, ["the cat sat", "THE!! CAT!!", "été là", ""][k % 4] * (k % 3 + 1)) for k in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_weight for r in rs.sample(df, labels(spark, [(k, int(k % 4 != 1), 0) for k in range(24)])).collect()}
    want = brute_weights([t for _, t in rows], [k % 4 != 1 for k, _ in rows])
    assert np.allclose([got[k] for k, _ in rows], want)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1e3, 500), [0.0, -0.0, 1e300, -1e300, 7.0, 7.0, 7.0]])
    keys = np.sort(rs.ordered(x))[::-1]
    assert (np.argsort(rs.ordered(rng.permutation(x)), kind="stable").size) == len(x)
    assert all(a >= b for a, b in zip(np.sort(x)[::-1], np.sort(x)[::-1][1:], strict=False)) and (np.diff(rs.ordered(np.sort(x))) >= 0).all()
    df = spark.createDataFrame([(int(k),) for k in keys] + [(-(2**63),), (2**63 - 1,)], "key long")
    whole = sorted([int(k) for k in keys] + [-(2**63), 2**63 - 1], reverse=True)
    for k in (1, 2, 3, 100, 250, 400, len(whole) - 1, len(whole)):
        assert rs.kth_largest(df, k) == whole[k - 1]


def test_top_k_has_k_rows(spark, sf):
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rs.sample(docs, lab).collect()
    k = sum(r.log_weight >= rs.FLOOR for r in rows)
    chosen = [r for r in rows if r.kept]
    assert len(rows) == docs.count() and len(chosen) == k
    assert min(r.gumbel_key for r in chosen) > max((r.gumbel_key for r in rows if not r.kept), default=-np.inf)
    kept = rs.keep_selected(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in chosen}


def test_keeps_good_and_rejects_junk(spark, sf):
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = rs.sample(docs, lab).join(lab, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in got.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.4


def test_bound_on_labels(spark):
    lab = labels(spark, [(k, 1, 0) for k in range(50)] * 2)
    assert len(rs.target_ids(lab, 20)) == 20 and rs.target_ids(lab, 20) <= rs.target_ids(lab.repartition(5), 50)


def test_edge_rows(spark):
    rows = rs.sample(edge(spark), labels(spark)).collect()
    assert len(rows) == len(EDGE) and len({(r.log_weight, r.gumbel_key, r.kept) for r in rows if r.doc_id == 4}) == 1
    assert all(r.kept and r.log_weight == 0 for r in rs.sample(edge(spark), labels(spark).limit(0)).collect())
    kept = rs.keep_selected(edge(spark), labels(spark))
    assert kept.columns == edge(spark).columns and kept.count() == sum(r.kept for r in rows)
    assert rs.sample(empty(spark), labels(spark)).count() == 0 and rs.keep_selected(empty(spark), labels(spark)).count() == 0


def test_doubles_come_back():
    for x in (-30.5, -0.25, 0.0, 1e-300, 7.75):
        assert rs.unordered(int(rs.ordered(np.array([x]))[0])) == x


def test_k_hangs_on_the_weights_of_good_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, lab = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rs.sample(docs, lab).join(lab, "doc_id", "left").select("log_weight", "kept", "quality").collect()
    good = sorted(r.log_weight for r in rows if r.quality == 1)
    floor = good[int(rs.QUANTILE * len(good))] - rs.MARGIN
    assert floor > rs.FLOOR and sum(r.kept for r in rows) == sum(r.log_weight >= floor for r in rows)
    share = {v: np.mean([r.kept for r in rows if r.quality == v]) for v in (0, 1)}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_top_k_samples_and_is_no_threshold(spark):
    """For a given k, kept rows are the k largest of weight plus noise, and each row's share over seeds is that of brute-force draws."""
    rows = [(k, ["aa", "ab", "ba", "bb", "c"][k % 5]) for k in range(60)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(k, 1, 0) for k in range(60) if k % 5 < 2 or k % 7 == 0])
    got = {r.doc_id: r for r in rs.sample(df, lab, k=20, seed=3).collect()}
    weight = np.array([got[k].log_weight for k in range(60)])
    key = weight + rs.gumbel(list(range(60)), [t for _, t in rows], 3)
    assert {k for k in got if got[k].kept} == set(np.argsort(-key)[:20].tolist())
    assert {k for k in got if got[k].kept} != set(np.argsort(-weight)[:20].tolist())
    assert {r.doc_id for r in rs.keep_selected(df, lab, k=20, seed=3).collect()} == {k for k in got if got[k].kept}
    share, want, rng = np.zeros(60), np.zeros(60), np.random.default_rng(1)
    for seed in range(2000):
        share[np.argsort(-(weight + rs.gumbel(list(range(60)), [t for _, t in rows], seed)))[:20]] += 1 / 2000
        left, p = list(range(60)), np.exp(weight - weight.max())
        for _ in range(20):  # without replacement, one after the other
            drawn = rng.choice(len(left), p=p[left] / p[left].sum())
            want[left.pop(drawn)] += 1 / 2000
    assert np.abs(share - want).max() < 0.07 and ((share > 0.02) & (share < 0.98)).sum() > 20
    assert all(r.kept for r in rs.sample(df, lab, k=1000).collect()) and not any(r.kept for r in rs.sample(df, lab, k=0).collect())
