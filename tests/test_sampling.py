from collections import Counter

import pytest
from pyspark.sql import functions as F

from arborlane.functions.hashing import exact_rank, hash32
from arborlane.functions.ranking import average_rank, running_sums
from arborlane.operators import sampling as s


def table(spark, n=500):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"), (F.col("id") % 3).alias("g"))


def test_ranks_do_not_hang_on_partitions_or_buckets(spark):
    df = table(spark)
    read = lambda d: sorted((r.k, r["rank"], r["size"]) for r in d.collect())
    want = read(exact_rank(df.repartition(1), 7, "k", ("g",)))
    assert read(exact_rank(df.repartition(9), 7, "k", ("g",))) == want == read(exact_rank(df, 7, "k", ("g",), buckets=3))
    assert sorted(Counter(r for _, r, _ in want).values())[-1] == 3


def test_null_groups_rank_on_their_own(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k long, g string")
    assert sorted((str(r.g), r["size"]) for r in exact_rank(df, 1, "k", ("g",)).collect()) == [("None", 2), ("None", 2), ("a", 1)]


def test_hash_is_md5(spark):
    import hashlib

    assert spark.range(1).select(hash32("s", F.lit("k"))).first()[0] == int(hashlib.md5(b"s:k").hexdigest()[:8], 16)


def test_split_is_exact_disjoint_and_refuses(spark):
    df = table(spark)
    rows = s.stratified_split(df, "k", "y").collect()
    assert len({r.k for r in rows}) == 500 and Counter((r.y, r.split) for r in rows)[1, "test"] == 10
    single = df.where("k < 5 or k = 10").withColumn("y", F.when(F.col("k") == 3, 2).otherwise(F.col("y")))
    assert all(r.split == "train" for r in s.stratified_split(single, "k", "y").where("y = 2").collect())
    with pytest.raises(ValueError):
        s.stratified_split(df.where("y = 0"), "k", "y")
    with pytest.raises(ValueError):
        s.stratified_split(df.limit(0), "k", "y")
    with pytest.raises(KeyError):
        s.stratified_split(df, "k", "gone")


def test_undersample(spark):
    df = table(spark)
    assert Counter(r.y for r in s.undersample(df, "k", "y", 1.5).collect()) == {0: 75, 1: 50}
    assert s.undersample(df, "k", "y", 100.0).count() == 500
    for bad in (lambda: s.undersample(df, "k", "y", 0), lambda: s.undersample(df.where("y = 0"), "k", "y", 1), lambda: s.undersample(df.withColumn("y", F.col("g")), "k", "y", 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        s.undersample(df, "k", "gone", 1)


def test_shards(spark):
    df = table(spark, 103)
    assert sorted(Counter(r.shard_id for r in s.shard_iid(df, "k", 10).collect()).values()) == [4] + [11] * 9
    assert sorted(Counter(r.shard_id for r in s.shard_plain(df, "k", 10).collect()).values()) == [10] * 7 + [11] * 3
    per = Counter((r.y, r.shard_id) for r in s.shard_stratified(df, "k", "y", 4).collect())
    assert {n for (y, _), n in per.items() if y == 1} == {2, 3}
    with pytest.raises(ValueError):
        s.assign_shards(spark.range(4).toDF("shard_id"), spark.range(2).toDF("task_id"), 4)


def test_quotas(spark):
    assert s.quota_split(10, 4) == [3, 3, 2, 2] and s.tree_chunks(10, 4) == [(0, 3), (3, 6), (6, 9), (9, 10)] and s.round_steps(45, 1) == [(0, 20), (20, 40), (40, 45)]
    got = lambda rows, **o: {r.worker: r.trees for r in s.tree_quotas(spark.createDataFrame(rows, "worker long, size long"), 10, **o).collect()}
    assert got([(0, 1), (1, 1), (2, 1)]) == {0: 4, 1: 3, 2: 3}
    assert got([(0, None), (1, None)]) == {0: 5, 1: 5} and got([(0, 0), (1, 0)]) == {0: 5, 1: 5}
    assert got([(0, 0), (1, 30), (2, None)]) == {0: 0, 1: 7, 2: 3} or sum(got([(0, 0), (1, 30), (2, None)]).values()) == 10
    assert s.shard_count("classifier", 3) == 20 and s.shard_count("regressor", 3) == 3
    assert s.tree_seed(5, 2) == 7 and s.tree_seed(5, 2, 3) == 3007


def test_protected_days(spark):
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") < 60, "p").otherwise("q").alias("day"), (F.col("id") % 4 != 0).alias("benign"))
    got = Counter((r.day, r.benign) for r in s.protected_rebalance(df, "k", "day", ["p"], F.col("benign"), 20).collect())
    assert got["p", False] == 15 and got["p", True] == 5 and got["q", True] + got["q", False] == 20


def test_running_sums_with_ties_and_groups(spark):
    rows = [(i, float(i % 7), i % 2, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double, g long, n long")
    for ranges in (1, 4, 64):
        for down in (False, True):
            for r in running_sums(df, "x", {"upto": "n"}, ("g",), down, ranges).collect():
                assert r.upto == sum(g == r.g and (x >= r.x if down else x <= r.x) for _, x, g, _ in rows)
    ranks = {r.x: r.r for r in average_rank(df, "x", "r").collect()}
    assert ranks[0.0] == (1 + sum(x == 0 for _, x, _, _ in rows)) / 2
