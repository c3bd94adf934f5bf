"""Extra columns named as operators name their own stay as they are."""

import pytest
from pyspark.sql import functions as F

from arborlane.functions.hashing import exact_rank
from arborlane.functions.ranking import running_sums
from arborlane.operators import forest, packed, sampling, voting
from arborlane.plans import federated
from arborlane.sources import files

NAMES = "__h __b __g __n __local __before __size __r __s __kind __group __others __p __b0 __l0 __t0 __day __shard __ones __zeros __in __a __c __f __at __order".split()


@pytest.fixture
def rows(spark):
    return spark.range(60).select("id", (F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("y"), *[F.concat(F.lit(c), F.col("id")).alias(c) for c in NAMES]).persist()


CASES = {
    "exact_rank": lambda df: exact_rank(df, 1, "id", ("g",)),
    "running_sums": lambda df: running_sums(df, "id", {"upto": "y"}),
    "quota_sample": lambda df: sampling.quota_sample(df, "id", "g", 5),
    "fraction_sample": lambda df: sampling.fraction_sample(df, "id", "g", 0.5),
    "protected_rebalance": lambda df: sampling.protected_rebalance(df, "id", "g", [1], F.col("y") == 0, 10),
    "split": lambda df: sampling.split_by_rank(df, "id", ("g",), 0.3, 1),
    "undersample": lambda df: sampling.undersample(df, "id", "y", 0.5),
    "shard_iid": lambda df: sampling.shard_iid(df, "id", 4),
    "shard_by_day": lambda df: sampling.shard_by_day(df, "g", 2),
    "shard_stratified": lambda df: sampling.shard_stratified(df, "id", "y", 4),
    "shard_plain": lambda df: sampling.shard_plain(df, "id", 4),
    "absolute_sample": lambda df: sampling.absolute_sample(df, "id", "y", 20),
    "prediction_sample": lambda df: sampling.prediction_sample(df, "id", 20),
    "prepare_shards": lambda df: federated.prepare_shards(df, "id", "g", "y", 0.5),
    "chunk_sample": lambda df: files.chunk_sample(df, "g", "id", 0.5, chunk=10),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_extra_columns_stay(rows, name):
    got = CASES[name](rows).collect()
    assert got and all(r[c] == f"{c}{r.id}" for r in got for c in NAMES)


def test_sums_are_the_votes(spark):
    """Votes summed where rows are scored are those that are summed by key, also over several parts."""
    nodes = [(t, 0, 0, 10.0 * (t + 1), 1, 2, None, None) for t in range(5)]
    nodes += [(t, k, None, None, None, None, 30 * k + t, [0.2 * k + 0.05 * t, 1 - 0.2 * k - 0.05 * t]) for t in range(5) for k in (1, 2)]
    nodes, df = spark.createDataFrame(nodes, forest.NODES), spark.range(60)
    votes = forest.score(df, nodes, ["id"], "id")
    for cap, want in ((None, voting.soft_vote(votes, "id", [0, 1])), (50, voting.leaf_weighted_vote(votes, "id", [0, 1]))):
        want = {r.id: (r.trees, r.yhat, [round(p, 12) for p in r.probs]) for r in want.collect()}
        for most in (packed.NODES_AT_ONCE, 4):
            old, packed.NODES_AT_ONCE = packed.NODES_AT_ONCE, most
            got = voting.from_sums(forest.vote_sums(df, nodes, ["id"], "id", 2, cap), "id", [0, 1])
            packed.NODES_AT_ONCE = old
            assert {r.id: (r.trees, r.yhat, [round(p, 12) for p in r.probs]) for r in got.collect()} == want


def test_votes_need_no_shuffle(spark):
    nodes = spark.createDataFrame([(0, 0, None, None, None, None, 3, [0.5, 0.5])], forest.NODES)
    plan = voting.from_sums(forest.vote_sums(spark.range(9), nodes, ["id"], "id", 2), "id", [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
