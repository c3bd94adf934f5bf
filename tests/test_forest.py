import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlane.operators import forest, metrics, packed, selection, voting
from arborlane.plans import federated
from arborlane.queries import forests
from arborlane.schemas import Hyperparameters
from arborlane.sources import synthetic


def planted(spark, n=1500):
    df = spark.range(n).select(F.col("id"), *[synthetic.unit(3, k).alias(f"x{k}") for k in range(4)])
    return df.withColumn("Label", ((F.col("x0") > 0.5) & (F.col("x1") > 0.3)).cast("int"))


NAMES = [f"x{k}" for k in range(4)]


def test_node_table_scores_like_mllib(spark):
    df = planted(spark)
    model = forest.train(df, Hyperparameters(n_estimators=5, max_depth=4), NAMES)
    from arborlane.operators.clean import separate

    want = [float(r.probability[1]) for r in model.transform(separate(df.orderBy("id"), "Label", NAMES)).collect()]
    nodes = forest.node_table(model)
    got = voting.soft_vote(forest.score(df, nodes, NAMES, "id"), "id", [0, 1]).orderBy("id").collect()
    assert np.allclose([r.probs[1] for r in got], want) and all(r.trees == 5 for r in got)
    assert nodes.where("feature is null and (dist is null or support is null)").count() == 0


def test_trees_in_parts_score_the_same(spark, monkeypatch):
    df = forests.flows(spark, "/root/testdata/sf0.001")
    one = sorted(map(str, forests.forest_score(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(packed, "NODES_AT_ONCE", 6)
    assert df.count() * 3 == len(one) and sorted(map(str, forests.forest_score(spark, "/root/testdata/sf0.001").collect())) == one


def test_learns_and_regresses(spark):
    df = planted(spark)
    nodes = forest.node_table(forest.train(df, Hyperparameters(n_estimators=8, max_depth=6, class_weight="balanced"), NAMES))
    rows = voting.soft_vote(forest.score(df, nodes, NAMES, "id"), "id", [0, 1]).select("id", F.element_at("probs", 2).alias("p")).join(df.select("id", F.col("Label").alias("y")), "id")
    assert metrics.auc(rows).first().auc > 0.95
    wide = synthetic.friedman(spark, 1500, 6, noise=0.1)
    names = [f"Feature_{k}" for k in range(6)]
    nodes = forest.node_table(forest.train(wide, Hyperparameters(tree_type="regressor", n_estimators=10, max_depth=8, max_features=0.8), names))
    got = voting.regression_mean(forest.score(wide, nodes, names, "id"), "id").join(wide.select("id", "Target"), "id")
    assert metrics.regression_metrics(got, "Target", "yhat").first().r2 > 0.7


def test_bootstrap_counts(spark):
    rows = forest.bootstrap_weights(spark.range(200).toDF("k"), "k", 3, 0.5).collect()
    for t in range(3):
        own = [r.weight for r in rows if r.tree_id == t]
        assert len(own) == 200 and sum(own) == 100


def test_best_split_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x double, y int")
    r = forest.best_splits(df, ["x"], "y").first()
    assert (r.threshold, r.gain) == (2.5, 0.5)
    assert forest.best_splits(df, ["x"], "y", "entropy").first().gain == 1.0


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, 10, [1.0, 0.0]), (1, 1, 90, [0.0, 1.0]), (2, 0, 0, [0.5, 0.5])], "k long, tree_id long, support long, dist array<double>")
    got = {r.k: (r.probs, r.yhat) for r in voting.leaf_weighted_vote(v, "k", [0, 1]).collect()}
    assert math.isclose(got[1][0][1], 50 / 60) and got[1][1] == 1 and got[2] == ([0.0, 0.0], 0)
    assert {r.k: r.yhat for r in voting.soft_vote(v, "k", [0, 1]).collect()} == {1: 0, 2: 0}
    with pytest.raises(ValueError):
        voting.with_threshold(v, 0.5, [0, 1, 2])
    assert voting.ensemble_status(v.limit(0), 2).first().status == "FAILED"


def test_curves_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "y int, p double")
    points = {r.threshold: (r.tp, r.fp) for r in metrics.curve(df).collect()}
    assert points == {0.9: (1, 1), 0.8: (2, 1), 0.1: (2, 2)}
    assert metrics.f1_threshold(metrics.curve(df)).first().threshold == 0.8
    assert metrics.fpr_threshold(metrics.curve(df), 0.0).count() == 0
    assert metrics.auc(df).first().auc == 0.625 and metrics.auc(df.where("y = 1")).first().auc is None
    assert metrics.pooled_threshold(df).count() == 0


def test_ward_and_selection(spark):
    c = np.array([[1, 0.95, 0.1], [0.95, 1, 0.1], [0.1, 0.1, 1.0]])
    assert selection.ward_clusters(c) == [0, 0, 1]
    assert selection.representatives(["a", "b", "c"], [0, 0, 1], {"a": 1, "b": 2, "c": 0.5}) == (["b", "c"], ["a"])
    df = spark.range(300).select(F.col("id"), synthetic.unit(1, 0).alias("a"), synthetic.unit(1, 1).alias("c"), F.lit(1.0).alias("k")).withColumn("b", F.col("a") * 2)
    chooser = selection.Selector()
    found = chooser.fit(df, ["a", "b", "c", "k"], {"a": 1.0, "b": 2.0, "c": 0.0, "k": 1.0})
    assert (found["kept"], found["constant"], found["unimportant"], found["redundant"]) == (["b"], ["k"], ["c"], ["a"])
    assert chooser.fit(None, [], {}) is found


def test_permutation_importance_finds_the_signal(spark):
    df = planted(spark, 600)
    nodes = forest.node_table(forest.train(df, Hyperparameters(n_estimators=3, max_depth=3, max_features="all"), NAMES))
    out_of = ([0, 1, 2], F.array(*[forest.drawn(1.0, t, "id").cast("int") for t in range(3)]))
    nodes = nodes.withColumn("dist", F.when(F.col("dist").isNotNull() & (F.col("support") < 3), F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.col("dist")))
    noisy = df.withColumn("Label", F.when(F.col("id") % 20 == 0, 1 - F.col("Label")).otherwise(F.col("Label")))
    got = {r.feature: r.importance for r in selection.permutation_importance(noisy, nodes, out_of, NAMES, "id", "Label").collect()}
    assert min(got["x0"], got["x1"]) > 50 > max(abs(got["x2"]), abs(got["x3"]))


def test_permuted_values_are_a_cycle_in_one_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(selection, "BUCKET_ROWS", 40)
    spark.range(500).withColumn("v", F.col("id") * 2).withColumn("h", F.lit(1)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = selection.with_next(df, "s", "id", ["v"], ["w"])
    rows = {r.id: r.w // 2 for r in out.collect()}
    order = [r.id for r in df.orderBy(forest.hash32("s", "id"), "id").collect()]
    assert rows == dict(zip(order, order[1:] + order[:1], strict=True))
    wide = df.withColumns({f"c{i}": F.col("v") + i for i in range(30)})
    plans = [selection.with_next(d, "s", "id", c, [f"n_{x}" for x in c])._jdf.queryExecution().executedPlan().toString() for d, c in ((df, ["v"]), (wide, [f"c{i}" for i in range(30)]))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
    assert selection.with_next(df.limit(1), "s", "id", ["v"], ["w"]).first().w == df.limit(1).first().v


def test_spearman_ranks_pairs_over_the_rows_that_they_have(spark):
    rng = np.random.default_rng(1)
    rows = [(float(k % 7), None if k % 5 == 0 else float(rng.integers(0, 9)), None if k % 3 == 1 else float(rng.normal()), 1.0) for k in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(4)
    want = df.toPandas().corr(method="spearman")
    for r in selection.spearman(df, ["a", "b", "c", "d"]).collect():
        expected = want.loc[r.a, r.b]
        assert (r.rho is None and "d" in (r.a, r.b)) or math.isclose(r.rho, expected, abs_tol=1e-9)
    few = spark.createDataFrame([(1, 2), (2, None), (3, 1), (4, 5)], "a int, b int")
    assert {(r.a, r.b): round(r.rho, 9) for r in selection.spearman(few, ["a", "b"]).collect()} == {("a", "a"): 1.0, ("a", "b"): 0.5, ("b", "b"): 1.0}
    assert selection.spearman(df.limit(0), ["a", "b"]).where("rho is null").count() == 3
    plans = [selection.spearman(df.na.fill(0.0), c)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for c in (["a"], ["a", "b", "c", "d"])]
    assert plans[0] == plans[1]


def test_federated(spark):
    df = planted(spark).withColumn("shard_id", F.col("id") % 3)
    parts = federated.prepare_shards(df, "id", "shard_id", "Label", 1.0)
    assert {r.part for r in parts.select("part").distinct().collect()} == {"train", "validation"}
    for r in parts.where("part = 'train'").groupBy("shard_id").pivot("Label", [0, 1]).count().collect():
        assert r["0"] == r["1"]
    got = federated.train_shards(parts.where("part = 'train'"), Hyperparameters(n_estimators=6, max_depth=5), NAMES, "id", "shard_id")
    assert sum(got.quotas.values()) == 6 and got.nodes.select("tree_id").distinct().count() == 6
    rows, each, macro = federated.evaluate_shards(df, got.nodes, NAMES, "id", "shard_id", "Label")
    assert rows.count() == 1500 and each.count() == 3 and macro.first().auc > 0.9


def test_shard_without_minority_trains_as_it_is(spark):
    df = planted(spark, 300).withColumn("shard_id", F.col("id") % 2).withColumn("Label", F.when(F.col("shard_id") == 1, 0).otherwise(F.col("Label")))
    parts = federated.prepare_shards(df, "id", "shard_id", "Label", 1.0)
    assert parts.where("shard_id = 1 and part = 'train'").count() == 150


def test_search(spark):
    found = forest.search(planted(spark, 400), NAMES, "id", "Label", trials=2, space={"n_estimators": [2, 4], "criterion": ["gini", "entropy"]}, depth=3)
    assert len(found) == 2 and found[0][0] >= found[1][0]


def test_a_lost_search_goes_on(spark, tmp_path, monkeypatch):
    space, scored = {"n_estimators": [1, 2, 3]}, []
    real = forest.out_of_bag
    monkeypatch.setattr(forest, "out_of_bag", lambda *a: scored.append(1) or real(*a))
    df, table = planted(spark, 200), str(tmp_path / "trials")
    first = forest.search(df, NAMES, "id", "Label", 2, space=space, depth=2, table=table)
    whole = forest.search(df, NAMES, "id", "Label", 9, space=space, depth=2, table=table)
    assert len(first) == 2 and len(whole) == 3 == len(scored) and set(map(str, first)) <= set(map(str, whole))


def test_trees_vote_for_the_rows_that_they_did_not_draw(spark):
    df = planted(spark, 2000)
    times = df.select(forest.drawn(0.5, "s", "id").alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 2000 for r in times}
    assert abs(share[0] - math.exp(-0.5)) < 0.04 and abs(share[1] - 0.5 * math.exp(-0.5)) < 0.04
    grown = forest.grow_forest(df, Hyperparameters(n_estimators=3, max_depth=4, max_samples=0.5), NAMES, "id")
    weights = forest.tree_weights(df, grown, "id")
    assert weights.count() == 6000
    covered = {r[0] for r in weights.where("weight = 0").select("id").distinct().collect()}
    rows = forest.out_of_bag(df, grown, NAMES, "id", "Label").collect()
    assert {r.id for r in rows} == covered and len(rows) == len(covered) < 2000
    assert sum(r.y == r.yhat for r in rows) > 0.8 * len(rows)
    votes = forest.oob_votes(forest.score(df, grown.nodes, NAMES, "id"), weights, "id")
    slow = {r.id: r.probs for r in voting.soft_vote(votes, "id", [0, 1]).collect()}
    assert all(math.isclose(r.p, slow[r.id][1]) for r in rows)


@pytest.mark.parametrize("at_once", [None, 8])
def test_learning_curve_like_the_table_of_votes(spark, monkeypatch, at_once):
    df = planted(spark, 500).withColumn("Label", F.when(F.col("id") % 5 == 0, 1 - F.col("Label")).otherwise(F.col("Label")))
    grown = forest.grow_forest(df, Hyperparameters(n_estimators=9, max_depth=3), NAMES, "id")
    votes, weights, steps = forest.score(df, grown.nodes, NAMES, "id"), forest.tree_weights(df, grown, "id"), [5, 1, 9, 3]
    for uncovered in (False, True):
        want = {r.trees: (r.covered, round(r.error, 9)) for r in forest.oob_curve(votes, weights, df, "id", "Label", steps, uncovered).collect()}
        if at_once:
            monkeypatch.setattr(packed, "NODES_AT_ONCE", at_once)
        got = forest.learning_curve(df, grown.nodes, NAMES, "id", "Label", grown.out_of, steps, uncovered)
        assert {r.trees: (r.covered, round(r.error, 9)) for r in got.collect()} == want
        plan = got._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and (at_once or "Generate explode(tree" not in plan)


def test_balanced_forest_on_a_feature_named_weight(spark):
    df = planted(spark, 400).withColumnRenamed("x0", "weight").withColumnRenamed("x1", "size")
    request = Hyperparameters(n_estimators=2, max_depth=3, class_weight="balanced", max_features="all")
    assert forest.node_table(forest.train(df, request, ["weight", "size"])).count() > 2
    assert forest.grow_forest(df, request, ["weight", "size"], "id").nodes.count() > 2


def test_nothing_of_the_trees_comes_to_the_driver(spark):
    df = planted(spark, 300)
    nodes = spark.range(400_000).selectExpr("id % 4 as tree_id", "id div 4 as node_id", "IF(id div 4 < 49999, 0L, NULL) as feature", "0.5D as threshold", "2 * (id div 4) + 1 as left", "2 * (id div 4) + 2 as right", "1L as support", "IF(id div 4 < 49999, NULL, array(0.5D, 0.5D)) as dist")
    seen, collect = [], type(nodes).collect
    try:
        type(nodes).collect = lambda self: seen.append(out := collect(self)) or out
        scored = forest.vote_sums(df, nodes, NAMES, "id", 2)
    finally:
        type(nodes).collect = collect
    assert sum(map(len, seen)) == 4  # a number and a size for each tree
    assert scored.where("trees = 4").count() == 300 and "Exchange" not in scored._jdf.queryExecution().toString()


def test_search_selects_features_for_each_max_features(spark):
    df = planted(spark, 400).withColumn("same", F.lit(1.0))
    chooser = selection.Selector()
    forest.search(df, [*NAMES, "same"], "id", "Label", 2, space={"n_estimators": [4], "max_features": ["sqrt", "log2"]}, depth=3, selector=chooser)
    assert set(chooser.cache) == {"sqrt", "log2"}
    for found in chooser.cache.values():
        assert found["constant"] == ["same"] and found["kept"] and not {"same"} & set(found["kept"])


def test_synthetic_tables_hang_on_seed_alone(spark):
    a, b = (synthetic.friedman(spark.newSession(), 100, 6).orderBy("id").collect() for _ in range(2))
    assert a == b and a != synthetic.friedman(spark, 100, 6, seed=9).orderBy("id").collect()
    with pytest.raises(ValueError):
        synthetic.friedman(spark, 10, 4)
    df = synthetic.classification(spark, 4000, 10)
    assert 0.07 < df.agg(F.avg("Label")).first()[0] < 0.14 and len(df.columns) == 12
    assert synthetic.worker_shard(spark, 2, 50).where("split = 'test'").count() == 10


def test_corners_are_distinct_in_any_number_of_dimensions(spark):
    for n, d in ((2, 1), (4, 2), (7, 3), (64, 40), (4, 300)):
        found = synthetic.corners(n, d, 5)
        assert len({tuple(c) for c in found}) == n and all(len(c) == d for c in found)
    assert all(0 < sum(bits) < 64 for bits in zip(*synthetic.corners(64, 40, 5), strict=True))  # every dimension tells some apart
    with pytest.raises(ValueError):
        synthetic.corners(5, 2, 1)
    df = synthetic.classification(spark, 3000, 45, informative=40, clusters=2)
    means = df.agg(*[F.corr(f"Feature_{k}", "Label").alias(str(k)) for k in range(40)]).first()
    assert sum(abs(m) > 0.1 for m in means) > 10


def test_provision(spark, tmp_path):
    df = planted(spark, 200).withColumn("day", F.concat(F.lit("d"), F.col("id") % 5))
    path = str(tmp_path / "p")
    made = federated.provision(df, path, "id", 3, "by_day", "day")
    assert made == {"partition_strategy": "by_day", "day_column": "day", "num_workers": 3} == federated.provision(df.limit(0), path, "id", 9)
    got = spark.read.parquet(f"{path}/shards")
    assert got.count() == 200 and got.select("day", "shard_id").distinct().count() == 5 and {r.split for r in got.select("split").distinct().collect()} == {"train", "test"}
    assert federated.provision(df, path, "id", 4, force=True)["num_workers"] == 4
    with pytest.raises(ValueError):
        federated.provision(df, str(tmp_path / "q"), "id", 3, "by_day")
