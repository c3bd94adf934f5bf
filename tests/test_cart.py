"""Exact trees against a brute-force grower with loops over rows and values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arborlane.operators import cart, forest
from arborlane.schemas import Hyperparameters


def sums_of(rows, classes, kind):
    """rows: (x, y, times).  Sums as the grower's."""
    if kind == "variance":
        return [sum(w for *_, w in rows), sum(w * y for _, y, w in rows), sum(w * y * y for _, y, w in rows)]
    return [sum(w for _, y, w in rows if y == c) for c in range(classes)]


def spread(sums, weights, kind):
    if kind == "variance":
        return sums[2] - sums[1] * sums[1] / sums[0]
    own = [s * w for s, w in zip(sums, weights, strict=True)]
    total = sum(own)
    if kind == "gini":
        return total - sum(c * c for c in own) / total
    return sum(-c * math.log(c / total) for c in own if c > 0)


def brute(rows, request, rule, seed, level=0, node=0):
    """A nested tuple: ("leaf", support, sums) or (feature, threshold, left, right); features are tried in the order that the grower's hash gives to a node by its path here."""
    classes, kind = len(rule.weights), rule.kind
    total = sums_of(rows, classes, kind)
    leaf = ("leaf", len(rows), [round(s, 9) for s in total])
    pure = sum(s > 0 for s in total) < 2 if kind != "variance" else spread(total, rule.weights, kind) <= 1e-12 * total[2]
    if len(rows) < request.min_samples_split or pure or (request.max_depth is not None and level >= request.max_depth):
        return leaf
    best = None
    for f in range(rule.features):
        values = sorted({x[f] for x, *_ in rows})
        for a, b in zip(values, values[1:], strict=False):
            low, high = [r for r in rows if r[0][f] <= a], [r for r in rows if r[0][f] > a]
            q = math.floor((1 - (spread(sums_of(low, classes, kind), rule.weights, kind) + spread(sums_of(high, classes, kind), rule.weights, kind)) / spread(total, rule.weights, kind)) * 2**30 + 0.5)
            if best is None or q > best[0]:
                best = (q, f, (a + b) / 2, low, high)
    if best is None:
        return leaf
    _, f, t, low, high = best
    return (f, t, brute(low, request, rule, seed, level + 1), brute(high, request, rule, seed, level + 1))


def nested(nodes, tree):
    own = {r.node_id: r for r in nodes if r.tree_id == tree}

    def at(k):
        r = own.pop(k)
        return ("leaf", r.support, r.dist) if r.feature is None else (r.feature, r.threshold, at(r.left), at(r.right))

    out = at(0)
    assert not own  # every node hangs on the root, once
    return out


def with_dist(tree, rule):
    if tree[0] != "leaf":
        return (*tree[:2], with_dist(tree[2], rule), with_dist(tree[3], rule))
    sums = tree[2]
    own = [sums[1]] if rule.kind == "variance" else [s * w for s, w in zip(sums, rule.weights, strict=True)]
    total = sums[0] if rule.kind == "variance" else sum(own)
    return ("leaf", tree[1], [round(c / total, 6) for c in own])


def rounded(tree):
    return ("leaf", tree[1], [round(x, 6) for x in tree[2]]) if tree[0] == "leaf" else (*tree[:2], rounded(tree[2]), rounded(tree[3]))


def table(spark, kind, n=160, seed=1):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 9) / 2, float(rng.randint(0, 30)), rng.random(), float(rng.randint(0, 2)) if kind != "variance" else rng.randint(0, 40) / 4) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, Label double").repartition(3)


@pytest.mark.parametrize("kind,local", [("gini", 1000), ("entropy", 1000), ("variance", 1000), ("gini", 40), ("variance", 40)])
def test_equals_brute_force_with_all_features(spark, kind, local):
    rows, df = table(spark, kind)
    request = Hyperparameters(n_estimators=2, max_features="all", criterion=kind if kind != "variance" else None, tree_type="classifier" if kind != "variance" else "regressor", target_column="Label", min_samples_split=5, max_depth=3 if local == 40 else None, class_weight="balanced" if kind == "gini" else None, max_samples=0.8)
    trees = [cart.Tree(4, 127), cart.Tree(9, 132)]
    nodes = cart.grow(df, request, ["a", "b", "c"], "id", trees, local=local).collect()
    rule = cart.rules(request, 3, cart.class_weights(cart.class_sizes(df, request), request) if kind != "variance" else (1.0,) * 3)
    for t in trees:
        times = {r.id: r.w for r in df.select("id", forest.drawn(0.8, t.seed, "id").alias("w")).collect()}
        drawn = [((a, b, c), y, times[i]) for i, a, b, c, y in rows if times[i]]
        assert rounded(nested(nodes, t.tree_id)) == with_dist(brute(drawn, request, rule, t.seed), rule)


def test_same_trees_however_dealt_and_however_rows_lie(spark):
    _, df = table(spark, "gini", 400, 3)
    request = Hyperparameters(n_estimators=6, max_features="sqrt", target_column="Label", max_depth=4)
    grow = lambda d, numbers, local: {str(tuple(r)) for r in cart.grow(d, request, ["a", "b", "c"], "id", [cart.Tree(k, 100 + k) for k in numbers], local=local).collect()}
    one = grow(df, range(6), None)
    assert one == grow(df.repartition(7), [5, 0, 3], None) | grow(df.coalesce(1), [1, 2, 4], None)
    levels = [grow(df, range(3), 150), grow(df.repartition(5), [2], 150) | grow(df, [0, 1], 150)]
    assert levels[0] == levels[1]


def test_levels_and_tasks_grow_the_same_trees_where_all_features_are_tried(spark):
    _, df = table(spark, "gini", 500, 4)
    request = Hyperparameters(max_features="all", target_column="Label", max_depth=4)
    trees = [cart.Tree(0, 5)]
    shapes = [rounded(nested(cart.grow(df, request, ["a", "b", "c"], "id", trees, local=n).collect(), 0)) for n in (10_000, 1)]
    assert shapes[0] == shapes[1]


def test_ranges_of_values_change_nothing(spark, monkeypatch):
    _, df = table(spark, "gini", 300, 5)
    request = Hyperparameters(max_features="all", target_column="Label", max_depth=2)
    grow = lambda: sorted(map(str, cart.grow(df, request, ["a", "b", "c"], "id", [cart.Tree(0, 5)], local=10).collect()))
    one = grow()
    monkeypatch.setattr(cart, "RANGE_ROWS", 20)
    assert grow() == one


def test_edges(spark):
    rows = [(1, None, 1), (2, float("nan"), 1), (3, float("inf"), 0), (4, 2.0, 0), (5, 2.0, None), (6, 2.0, 0)]
    df = spark.createDataFrame(rows, "id long, x double, Label long").withColumn("times", F.lit("clash"))
    request = Hyperparameters(bootstrap=False, max_features="all")
    nodes = cart.grow(df, request, ["x"], "id", [cart.Tree(0, 1)])
    assert sum(r.support for r in nodes.collect() if r.feature is None) == 5
    votes = {r.id: r.dist for r in forest.score(df, nodes, ["x"], "id").collect()}
    assert votes[1] == [0.0, 1.0] and votes[4] == [1.0, 0.0] and votes[2] == votes[3] == [0.5, 0.5]
    one = cart.grow(df.where("id = 1"), request, ["x"], "id", [cart.Tree(3, 1), cart.Tree(4, 2, "none")], shard="times")
    assert sorted((r.tree_id, r.support, r.dist) for r in one.collect()) == [(3, 0, [0.0, 0.0]), (4, 0, [0.0, 0.0])]
    with pytest.raises(ValueError):
        cart.grow(df.limit(0), request, ["x"], "id", [cart.Tree(0, 1)])


def test_depth_has_no_bound_of_its_own(spark):
    """Alternating labels along one feature, peeled one value at a time by weights that double."""
    df = spark.range(60).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("Label"))
    nodes = cart.grow(df, Hyperparameters(bootstrap=False, max_features="all"), ["x"], "id", [cart.Tree(0, 1)]).collect()
    assert sum(r.feature is None for r in nodes) == 60


def test_one_job_a_level_and_no_window_of_a_whole_feature(spark):
    _, df = table(spark, "gini", 200, 6)
    tracker, group = spark.sparkContext.statusTracker(), "cart-levels"
    request = Hyperparameters(max_features="all", target_column="Label", max_depth=2)
    spark.sparkContext.setJobGroup(group, group)
    cart.grow(df, request, ["a", "b", "c"], "id", [cart.Tree(k, k) for k in range(4)], local=1)
    few = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group + "2", group)
    cart.grow(df, request, ["a", "b", "c"], "id", [cart.Tree(k, k) for k in range(12)], local=1)
    assert len(tracker.getJobIdsForGroup(group + "2")) == few  # jobs grow with depth and not with trees
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
def test_equal_rows_are_summed_once_and_change_no_tree(spark, monkeypatch, kind):
    df = spark.range(4000).selectExpr("id", "double(id % 7) AS a", "double(id * 31 % 11) AS b", "int((id % 7 > 3) != (id % 13 = 0)) + int(id % 5 = 1 AND id * 31 % 11 > 6) AS Label")
    request = Hyperparameters(tree_type=kind, n_estimators=3, max_depth=4, min_samples_split=5, max_features="all", target_column="Label")
    scans = []
    own = cart._ranges
    monkeypatch.setattr(cart, "_ranges", lambda rows, n, *rest: scans.append(n) or own(rows, n, *rest))

    def leaves(local):
        trees = [cart.Tree(t, 50 + t) for t in range(3)]
        nodes = cart.grow(df, request, ["a", "b"], "id", trees, local=local)
        return sorted((r.event, r.tree_id, r.support, tuple(round(x, 9) for x in r.dist)) for r in forest.score(df.withColumnRenamed("id", "event"), nodes, ["a", "b"], "event").collect())

    rows = leaves(5000)  # one task finishes each tree from its rows
    assert leaves(500) == rows and leaves(1) == rows
    assert scans[0] == 4000 and max(scans[1:]) <= 3 * 77  # levels read the 77 different rows of each tree
