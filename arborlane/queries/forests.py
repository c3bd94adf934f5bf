from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import clean, forest, sampling, selection, voting
from ..schemas import Hyperparameters
from ..session import scratch
from ..sources import pmml, synthetic
from .base import FLOWS, flows, h

FEATURES = ["value", "hour", "k"]
#: Literal trees: tree_id, node_id, feature, threshold, left, right, support, share of class 1.
TREES = [
    (0, 0, 0, 50.0, 1, 2, None, None), (0, 1, 1, 11.0, 3, 4, None, None), (0, 2, None, None, None, None, 70, 0.75), (0, 3, None, None, None, None, 12, 0.25), (0, 4, 2, 40.0, 5, 6, None, None), (0, 5, None, None, None, None, 30, 0.5), (0, 6, None, None, None, None, 8, 0.125),
    (1, 0, 2, 60.0, 1, 2, None, None), (1, 1, None, None, None, None, 44, 0.375), (1, 2, 0, 20.0, 3, 4, None, None), (1, 3, None, None, None, None, 3, 1.0), (1, 4, None, None, None, None, 90, 0.0625),
    (2, 0, 1, 5.0, 1, 2, None, None), (2, 1, 0, 100.0, 3, 4, None, None), (2, 2, None, None, None, None, 51, 0.625), (2, 3, None, None, None, None, 0, 0.5), (2, 4, None, None, None, None, 49, 0.875),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in r) + ")" for r in TREES)
NODES_SQL = f"nodes AS (SELECT tree_id::BIGINT AS tree_id, node_id, feature, threshold::DOUBLE AS threshold, l, r, support::BIGINT AS support, p::DOUBLE AS p FROM (VALUES {_VALUES}) AS t(tree_id, node_id, feature, threshold, l, r, support, p))"
#: Scores rows in the same trees by walking down a level at a time.
SCORE_SQL = f"""{FLOWS}, {NODES_SQL}, walk AS (SELECT event_id, value, hour, k, tree_id, 0 AS node_id FROM flows, (SELECT DISTINCT tree_id FROM nodes)
  UNION ALL SELECT w.event_id, w.value, w.hour, w.k, w.tree_id, CASE WHEN (CASE n.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.k END) <= n.threshold THEN n.l ELSE n.r END FROM walk w JOIN nodes n USING (tree_id, node_id) WHERE n.feature IS NOT NULL),
  votes AS (SELECT w.event_id, w.tree_id, n.support, n.p FROM walk w JOIN nodes n USING (tree_id, node_id) WHERE n.feature IS NULL)"""


def nodes(spark, regression: bool = False):
    rows = [(*r[:7], None if r[7] is None else [r[7]] if regression else [1 - r[7], r[7]]) for r in TREES]
    return spark.createDataFrame(rows, forest.NODES)


def votes(spark, sf, regression: bool = False):
    return forest.score(flows(spark, sf), nodes(spark, regression), FEATURES, "event_id")


def forest_score(spark, sf):
    return votes(spark, sf).select("event_id", "tree_id", "support", F.element_at("dist", 2).alias("p"))


def _p(df):
    return df.select("event_id", F.round(F.element_at("probs", 2), 9).alias("p"), F.col("yhat").cast("long").alias("yhat"))


def soft_vote(spark, sf):
    return _p(voting.soft_vote(votes(spark, sf), "event_id", [0, 1]))


def leaf_weighted_vote(spark, sf):
    return _p(voting.leaf_weighted_vote(votes(spark, sf), "event_id", [0, 1]))


def threshold_vote(spark, sf):
    return _p(voting.with_threshold(voting.soft_vote(votes(spark, sf), "event_id", [0, 1]), 0.42, [0, 1]))


def regression_vote(spark, sf):
    v = votes(spark, sf, True)
    a, b = voting.regression_mean(v, "event_id"), voting.leaf_weighted_regression(v, "event_id")
    return a.join(b.select("event_id", F.col("yhat").alias("weighted")), "event_id").select("event_id", "trees", F.round("yhat", 9).alias("mean"), F.round("weighted", 9).alias("weighted"))


def class_alignment(spark, sf):
    v = voting.aligned(votes(spark, sf), [0, 2], [0, 1, 2])
    return voting.long_votes(v, "event_id", [0, 1, 2]).groupBy(F.col("class").cast("long").alias("class")).agg(F.round(F.sum("p"), 6).alias("total"))


def ensemble_status(spark, sf):
    return voting.ensemble_status(votes(spark, sf).where("tree_id < 2"), 3)


def pooled_results(spark, sf):
    df = flows(spark, sf).select("event_id", (F.col("user_id") % 3).alias("worker"), F.when(F.col("user_id") % 3 != 2, F.col("value")).alias("p"))
    return voting.pooled_results(df).groupBy("worker").agg(F.count("*").alias("n"), F.count("p").alias("with_p"))


BOOT_TREES, BOOT_SEED = 3, 123


def bootstrap_weights(spark, sf):
    return forest.bootstrap_weights(flows(spark, sf), "event_id", BOOT_TREES, 0.7, BOOT_SEED)


_BOOT = f"""{FLOWS}, places AS (SELECT event_id, row_number() OVER (ORDER BY {h('123', 'event_id')}, event_id) AS place FROM flows), n AS (SELECT count(*) AS n FROM flows),
  draws AS (SELECT range % {BOOT_TREES} AS tree_id, range // {BOOT_TREES} AS draw FROM range((SELECT {BOOT_TREES} * CAST(floor(n * 0.7::DOUBLE) AS BIGINT) FROM n))),
  drawn AS (SELECT tree_id, ('0x' || substr(md5(CAST(tree_id + 123 AS VARCHAR) || ':' || CAST(draw AS VARCHAR)), 1, 8))::BIGINT % (SELECT n FROM n) + 1 AS place, count(*) AS w FROM draws GROUP BY 1, 2),
  weights AS (SELECT t.range AS tree_id, event_id, coalesce(w, 0) AS weight FROM places CROSS JOIN range({BOOT_TREES}) t LEFT JOIN drawn ON drawn.place = places.place AND drawn.tree_id = t.range)"""
_OOB = _BOOT + f""", {NODES_SQL}, walk AS (SELECT event_id, value, hour, k, tree_id, 0 AS node_id FROM flows, (SELECT DISTINCT tree_id FROM nodes)
  UNION ALL SELECT w.event_id, w.value, w.hour, w.k, w.tree_id, CASE WHEN (CASE n.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.k END) <= n.threshold THEN n.l ELSE n.r END FROM walk w JOIN nodes n USING (tree_id, node_id) WHERE n.feature IS NOT NULL),
  oob AS (SELECT w.event_id, w.tree_id, n.p FROM walk w JOIN nodes n USING (tree_id, node_id) JOIN weights g USING (tree_id, event_id) WHERE n.feature IS NULL AND g.weight = 0)"""


def oob_metrics(spark, sf):
    from ..operators.metrics import binary_metrics

    df = flows(spark, sf)
    v = forest.oob_votes(votes(spark, sf), bootstrap_weights(spark, sf), "event_id")
    rows = voting.soft_vote(v, "event_id", [0, 1]).join(df.select("event_id", F.col("label").alias("y")), "event_id")
    out = binary_metrics(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1")}).drop("fpr")


def oob_curve(spark, sf):
    df = flows(spark, sf)
    return forest.oob_curve(votes(spark, sf), bootstrap_weights(spark, sf), df, "event_id", "label", [1, 2, 3]).withColumn("error", F.round("error", 6))


def permutation_importance(spark, sf):
    df = forest.with_times(flows(spark, sf).select("event_id", "label", *FEATURES), "event_id", BOOT_TREES, 0.7, BOOT_SEED)
    out = selection.permutation_importance(df, nodes(spark), (list(range(BOOT_TREES)), F.col("times")), FEATURES, "event_id", "label")
    return out.withColumn("importance", F.round("importance", 6))


def _walked(name: str, columns: str, source: str) -> str:
    """SQL: the share of wrong out-of-bag votes of each tree over flows with these columns."""
    return f"""w_{name} AS (SELECT event_id, label, {columns}, tree_id, 0 AS node_id FROM {source}, (SELECT DISTINCT tree_id FROM nodes)
    UNION ALL SELECT w.event_id, w.label, w.value, w.hour, w.k, w.tree_id, CASE WHEN coalesce(CASE n.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.k END, 0) <= n.threshold THEN n.l ELSE n.r END FROM w_{name} w JOIN nodes n USING (tree_id, node_id) WHERE n.feature IS NOT NULL),
  e_{name} AS (SELECT tree_id, avg(CAST((n.p > 0.5) <> (label = 1) AS INTEGER)) AS e FROM w_{name} w JOIN nodes n USING (tree_id, node_id) JOIN weights g USING (tree_id, event_id)
    WHERE n.feature IS NULL AND g.weight = 0 GROUP BY tree_id)"""


def _permuted(f: str) -> str:
    """SQL: flows whose value of a feature comes from the row of another hash rank, and the errors over them."""
    columns = ", ".join(f"v.{c}" if c == f else f"a.{c}" for c in FEATURES)
    return f"""p_{f} AS (SELECT a.event_id, a.label, {columns} FROM (SELECT *, row_number() OVER (ORDER BY {h(f'123-{f}-a', 'event_id')}, event_id) AS r FROM filled) a JOIN (SELECT {f}, row_number() OVER (ORDER BY {h(f'123-{f}-b', 'event_id')}, event_id) AS r FROM filled) v USING (r)),
  {_walked(f, 'value, hour, k', f'p_{f}')}"""


_IMPORTANCE = f"""WITH RECURSIVE {_BOOT}, {NODES_SQL}, filled AS (SELECT event_id, label, {", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES)} FROM flows),
  {_walked('base', 'value, hour, k', 'filled')}, {", ".join(_permuted(f) for f in FEATURES)}
  """ + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg((e_{f}.e - e_base.e) / e_base.e * 100), 6) AS importance FROM e_base JOIN e_{f} USING (tree_id) WHERE e_base.e > 0" for f in FEATURES)


def best_split_gini(spark, sf):
    return _split(spark, sf, "label", "gini")


def best_split_entropy(spark, sf):
    return _split(spark, sf, "label", "entropy")


def best_split_variance(spark, sf):
    return _split(spark, sf, "value", "variance", ["hour", "k"])


def _split(spark, sf, target, kind, features=None):
    out = forest.best_splits(flows(spark, sf), features or FEATURES, target, kind)
    return out.withColumns({"gain": F.round("gain", 6), "threshold": F.round("threshold", 6)})


def _split_sql(target: str, kind: str, features: list[str]) -> str:
    pairs = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS x, CAST({target} AS DOUBLE) AS y FROM flows" for f in features)

    def imp(n: str, s: str, ss: str) -> str:
        p = f"({s} / {n})"
        if kind == "gini":
            return f"(2 * {p} * (1 - {p}))"
        if kind == "entropy":
            part = lambda q: f"(CASE WHEN {q} > 0 THEN -{q} * log2({q}) ELSE 0 END)"
            return f"({part(p)} + {part(f'(1 - {p})')})"
        return f"({ss} / {n} - {p} * {p})"

    gain = f"{imp('tn', 'ts', 'tss')} - (ln * {imp('ln', 'ls', 'lss')} + (tn - ln) * {imp('(tn - ln)', '(ts - ls)', '(tss - lss)')}) / tn"
    return f"""WITH {FLOWS}, pairs AS ({pairs}), v AS (SELECT feature, x, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM pairs GROUP BY feature, x),
  runs AS (SELECT feature, x, lead(x) OVER w AS nx, CAST(sum(n) OVER w AS DOUBLE) AS ln, sum(s) OVER w AS ls, sum(ss) OVER w AS lss, CAST(sum(n) OVER g AS DOUBLE) AS tn, sum(s) OVER g AS ts, sum(ss) OVER g AS tss FROM v WINDOW w AS (PARTITION BY feature ORDER BY x), g AS (PARTITION BY feature)),
  scored AS (SELECT feature, (x + nx) / 2 AS threshold, round({gain}, 9) AS gain FROM runs WHERE nx IS NOT NULL)
  SELECT feature, round(threshold, 6) AS threshold, round(gain, 6) AS gain FROM scored QUALIFY row_number() OVER (PARTITION BY feature ORDER BY scored.gain DESC, scored.threshold) = 1"""


def tree_seeds(spark, sf):
    found = flows(spark, sf).select(F.col("user_id") % 3, F.col("user_id") % 4).distinct().collect()  # a shard and a tree each
    rows = [(s, t, sampling.tree_seed(123, t), sampling.tree_seed(123, t, s)) for s, t in found]
    return spark.createDataFrame(rows, "shard long, tree long, central_seed long, shard_seed long")


def _planted(spark, sf):
    """Flows with a target that features do tell: noise in one row of eleven."""
    y = ((F.col("value") > 60) & (F.col("hour") >= 8)).cast("int")
    return flows(spark, sf).withColumn("Label", F.when(F.col("event_id") % 11 == 0, 1 - y).otherwise(y))


def train_rf_classifier(spark, sf):
    df = _planted(spark, sf)
    nodes = forest.grow_forest(df, Hyperparameters(n_estimators=8, max_depth=5, max_features="sqrt"), FEATURES, "event_id").nodes
    own = voting.from_sums(forest.vote_sums(df, nodes, FEATURES, "event_id", 2), "event_id", [0, 1])
    return own.select("event_id", F.element_at("probs", 2).alias("p"), F.col("yhat").cast("long").alias("yhat"))


def train_rf_regressor(spark, sf):
    """Prices of line items by quantity, discount and tax."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("Target"))
    names = ["l_quantity", "l_discount", "l_tax"]
    nodes = forest.grow_forest(df, Hyperparameters(**(forest.REGRESSOR | {"n_estimators": 4, "max_depth": 6})), names, "id").nodes
    return voting.mean_from_sums(forest.vote_sums(df, nodes, names, "id", 1), "id")


#: The query against SQL grows so many trees, so deep.
EXACT_TREES, EXACT_DEPTH = 3, 3


def grow_exact(spark, sf):
    """The leaf (rows and share of class 1) in which every flow ends, in exact trees on bootstrap samples."""
    df = _planted(spark, sf)
    request = Hyperparameters(n_estimators=EXACT_TREES, max_depth=EXACT_DEPTH, max_features="all", min_samples_split=20)
    nodes = forest.grow_forest(df, request, FEATURES, "event_id").nodes
    return forest.score(df, nodes, FEATURES, "event_id").select("event_id", "tree_id", "support", F.round(F.element_at("dist", 2), 9).alias("p"))


def _poisson(rate: float, u: str) -> str:
    """SQL of forest.drawn for a uniform number."""
    steps, below, term = [], 0.0, math.exp(-rate)
    for k in range(1, forest.MOST_DRAWS + 1):
        below += term
        steps.append(below)
        term *= rate / k
    return " + ".join(f"({u} >= {x!r}::DOUBLE)::BIGINT" for x in steps)


def _exact_sql() -> str:
    """Levels of growth one after another: sums by value, running sums, the best cut of each node, and rows a step down."""
    draws = f"SELECT t.range AS tree_id, f.*, ('0x' || substr(md5((123 + t.range)::VARCHAR || ':' || event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM planted f, range({EXACT_TREES}) t"
    columns = ", ".join(f"coalesce({f}::DOUBLE, 0.0) AS {f}" for f in FEATURES)
    parts = [
        f"""{FLOWS}, planted AS (SELECT event_id, {columns}, CASE WHEN event_id % 11 = 0 THEN 1 - hit ELSE hit END AS y FROM (SELECT *, (value > 60 AND hour >= 8)::BIGINT AS hit FROM flows)),
  drawn AS ({draws}), n0 AS (SELECT *, {_poisson(1.0, 'u')} AS w, 1::BIGINT AS node FROM drawn)"""
    ]
    imp = lambda a, b: f"(({a} + {b}) - ({a} * {a} + {b} * {b}) / ({a} + {b}))"
    for d in range(EXACT_DEPTH):
        long = " UNION ALL ".join(f"SELECT tree_id, node, {i} AS f, {f} AS x, w, y FROM n{d} WHERE w > 0" for i, f in enumerate(FEATURES))
        at = "CASE b.f " + " ".join(f"WHEN {i} THEN r.{f}" for i, f in enumerate(FEATURES)) + " END"
        parts.append(f"""v{d} AS (SELECT tree_id, node, f, x, count(*) AS n, sum(w * (1 - y))::DOUBLE AS a, sum(w * y)::DOUBLE AS b FROM ({long}) GROUP BY ALL),
  c{d} AS (SELECT tree_id, node, f, x, lead(x) OVER s AS nx, sum(a) OVER s AS la, sum(b) OVER s AS lb, sum(a) OVER g AS ta, sum(b) OVER g AS tb, sum(n) OVER g AS tn FROM v{d} WINDOW s AS (PARTITION BY tree_id, node, f ORDER BY x), g AS (PARTITION BY tree_id, node, f)),
  b{d} AS (SELECT tree_id, node, f, CASE WHEN (x + nx) / 2 < nx THEN (x + nx) / 2 ELSE x END AS threshold FROM c{d} WHERE nx IS NOT NULL AND ta > 0 AND tb > 0 AND tn >= 20
    QUALIFY row_number() OVER (PARTITION BY tree_id, node ORDER BY floor((1.0::DOUBLE - ({imp('la', 'lb')} + {imp('(ta - la)', '(tb - lb)')}) / {imp('ta', 'tb')}) * 1073741824.0::DOUBLE + 0.5::DOUBLE) DESC, f, (x + nx) / 2) = 1),
  n{d + 1} AS (SELECT r.* REPLACE (CASE WHEN b.f IS NULL THEN r.node WHEN {at} <= b.threshold THEN 2 * r.node ELSE 2 * r.node + 1 END AS node) FROM n{d} r LEFT JOIN b{d} b ON r.tree_id = b.tree_id AND r.node = b.node)""")
    last = f"n{EXACT_DEPTH}"
    return "WITH " + ",\n  ".join(parts) + f""",
  leaves AS (SELECT tree_id, node, count(*) AS support, round(sum(w * y)::DOUBLE / sum(w)::DOUBLE, 9) AS p FROM {last} WHERE w > 0 GROUP BY ALL)
SELECT event_id, tree_id, support, p FROM {last} JOIN leaves USING (tree_id, node)"""


def pmml_round_trip(spark, sf):
    """Votes of the literal trees after they were written as PMML and read back."""
    folder = scratch(spark, "pmml")
    pmml.write_pmml(nodes(spark), FEATURES, "label", folder)
    read = pmml.read_pmml(spark, folder, FEATURES)
    return _p(voting.from_sums(forest.vote_sums(flows(spark, sf), read, FEATURES, "event_id", 2), "event_id", [0, 1]))


#: Trees and sizes of the registered learning curve.
CURVE_TREES, CURVE_STEPS = 40, list(range(5, 41, 5))


def _many(spark):
    """The literal trees over and over, with other thresholds: numbers 0 to CURVE_TREES - 1."""
    rows = [(t, *r[1:3], None if r[3] is None else r[3] + t / 4, *r[4:7], None if r[7] is None else [1 - r[7], r[7]]) for t in range(CURVE_TREES) for r in TREES if r[0] == t % 3]
    return spark.createDataFrame(rows, forest.NODES)


def learning_curve(spark, sf):
    df = flows(spark, sf)
    times = F.array(*[forest.drawn(1.0, 123 + t, "event_id").cast("int") for t in range(CURVE_TREES)])
    return forest.learning_curve(df, _many(spark), FEATURES, "event_id", "label", (list(range(CURVE_TREES)), times), CURVE_STEPS).withColumn("error", F.round("error", 9))


_CURVE = f"""WITH RECURSIVE {FLOWS}, {NODES_SQL}, many AS (SELECT t.range AS tree_id, node_id, feature, threshold + t.range / 4.0::DOUBLE AS threshold, l, r, p FROM range({CURVE_TREES}) t JOIN nodes ON nodes.tree_id = t.range % 3),
  walk AS (SELECT event_id, value, hour, k, label, tree_id, 0 AS node_id FROM flows, (SELECT DISTINCT tree_id FROM many)
    UNION ALL SELECT w.event_id, w.value, w.hour, w.k, w.label, w.tree_id, CASE WHEN coalesce(CASE n.feature WHEN 0 THEN w.value WHEN 1 THEN w.hour ELSE w.k END, 0) <= n.threshold THEN n.l ELSE n.r END FROM walk w JOIN many n USING (tree_id, node_id) WHERE n.feature IS NOT NULL),
  votes AS (SELECT w.event_id, w.label, w.tree_id, n.p FROM walk w JOIN many n USING (tree_id, node_id) WHERE n.feature IS NULL AND ('0x' || substr(md5((123 + w.tree_id)::VARCHAR || ':' || w.event_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < {math.exp(-1.0)!r}::DOUBLE),
  means AS (SELECT s.trees, event_id, label, avg(p) AS p FROM votes JOIN (SELECT unnest({CURVE_STEPS}) AS trees) s ON tree_id < s.trees GROUP BY ALL)
SELECT trees::BIGINT AS trees, count(*) AS covered, round(count(*) FILTER ((p > 0.5) <> (label = 1)) / count(*)::DOUBLE, 9) AS error FROM means GROUP BY trees"""


def gini_importance(spark, sf):
    model = forest.train(_planted(spark, sf), Hyperparameters(n_estimators=5, max_depth=4), FEATURES)
    return spark.createDataFrame(forest.with_importances(model, FEATURES), "feature string, importance double, running_share double")


def federated_train(spark, sf):
    from ..plans.federated import train_shards

    df = _planted(spark, sf).withColumn("shard_id", F.col("user_id") % 3)
    return train_shards(df, Hyperparameters(n_estimators=6, max_depth=4), FEATURES, "event_id", "shard_id").nodes


def friedman1(spark, sf):
    return synthetic.friedman(spark, flows(spark, sf).count(), 6)  # a row for each flow


def synthetic_classification(spark, sf):
    return synthetic.classification(spark, flows(spark, sf).count(), 12)


def separate_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    return clean.separate(_planted(spark, sf), "Label", FEATURES).select(vector_to_array("features").alias("features"), "label")


def class_union(spark, sf):
    df = flows(spark, sf).groupBy((F.col("user_id") % 4).alias("tree")).agg(F.collect_set("label").alias("c"))
    return df.select(F.explode("c").alias("class")).distinct()


def balanced_weights(spark, sf):
    return forest.balanced_weights(flows(spark, sf), "subtype").groupBy("subtype").agg(F.round(F.first("weight"), 6).alias("weight"))


QUERIES = {
    "forest_score": (forest_score, f"WITH RECURSIVE {SCORE_SQL} SELECT event_id, tree_id, support, p FROM votes"),
    "pmml_round_trip": (pmml_round_trip, f"WITH RECURSIVE {SCORE_SQL} SELECT event_id, round(avg(p), 9) AS p, CAST(avg(p) > 0.5 AS BIGINT) AS yhat FROM votes GROUP BY event_id"),
    "soft_vote": (soft_vote, f"WITH RECURSIVE {SCORE_SQL} SELECT event_id, round(avg(p), 9) AS p, CAST(avg(p) > 0.5 AS BIGINT) AS yhat FROM votes GROUP BY event_id"),
    "leaf_weighted_vote": (
        leaf_weighted_vote,
        f"WITH RECURSIVE {SCORE_SQL}, w AS (SELECT event_id, sum(p * least(support, 50)) / CASE WHEN sum(least(support, 50)) = 0 THEN 1 ELSE sum(least(support, 50)) END AS q FROM votes GROUP BY event_id) SELECT event_id, round(q, 9) AS p, CAST(q > 0.5 AS BIGINT) AS yhat FROM w",
    ),
    "threshold_vote": (threshold_vote, f"WITH RECURSIVE {SCORE_SQL} SELECT event_id, round(avg(p), 9) AS p, CAST(avg(p) >= 0.42::DOUBLE AS BIGINT) AS yhat FROM votes GROUP BY event_id"),
    "regression_vote": (
        regression_vote,
        f"WITH RECURSIVE {SCORE_SQL} SELECT event_id, count(*) AS trees, round(avg(p), 9) AS mean, round(coalesce(sum(p * least(support, 50)) / nullif(sum(least(support, 50)), 0), 0), 9) AS weighted FROM votes GROUP BY event_id",
    ),
    "class_alignment": (class_alignment, f"WITH RECURSIVE {SCORE_SQL} SELECT 0::BIGINT AS class, round(sum(1 - p), 6) AS total FROM votes UNION ALL SELECT 1, 0 UNION ALL SELECT 2, round(sum(p), 6) FROM votes"),
    "ensemble_status": (
        ensemble_status,
        f"WITH RECURSIVE {SCORE_SQL} SELECT count(DISTINCT tree_id) AS found, 3::BIGINT AS expected, CASE WHEN count(DISTINCT tree_id) = 0 THEN 'FAILED' WHEN count(DISTINCT tree_id) < 3 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status FROM votes WHERE tree_id < 2",
    ),
    "pooled_results": (pooled_results, f"WITH {FLOWS} SELECT user_id % 3 AS worker, count(*) AS n, 0::BIGINT AS with_p FROM flows GROUP BY 1"),
    "bootstrap_weights": (bootstrap_weights, f"WITH {_BOOT} SELECT tree_id, event_id, weight FROM weights"),
    "oob_metrics": (
        oob_metrics,
        f"""WITH RECURSIVE {_OOB}, v AS (SELECT event_id, CAST(avg(p) > 0.5 AS INTEGER) AS yhat FROM oob GROUP BY event_id), c AS (SELECT count(*) FILTER (WHERE label = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE label = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE label = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE label = 0 AND yhat = 0) AS tn FROM v JOIN flows USING (event_id))
  SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c""",
    ),
    "oob_curve": (
        oob_curve,
        f"WITH RECURSIVE {_OOB}, t AS (SELECT t.range AS trees, event_id, avg(p) AS p FROM oob JOIN range(1, 4) t ON oob.tree_id < t.range GROUP BY 1, 2) SELECT trees, count(*) AS covered, round(count(*) FILTER (WHERE (p > 0.5) <> (label = 1)) / count(*)::DOUBLE, 6) AS error FROM t JOIN flows USING (event_id) GROUP BY trees",
    ),
    "permutation_importance": (permutation_importance, _IMPORTANCE),
    "best_split_gini": (best_split_gini, _split_sql("label", "gini", FEATURES)),
    "best_split_entropy": (best_split_entropy, _split_sql("label", "entropy", FEATURES)),
    "best_split_variance": (best_split_variance, _split_sql("value", "variance", ["hour", "k"])),
    "tree_seeds": (tree_seeds, f"WITH {FLOWS}, p AS (SELECT DISTINCT user_id % 3 AS shard, user_id % 4 AS tree FROM flows) SELECT shard, tree, 123 + tree AS central_seed, 123 + tree + 1000 * shard AS shard_seed FROM p"),
    "class_union": (class_union, f"WITH {FLOWS} SELECT DISTINCT label AS class FROM flows"),
    "balanced_weights": (balanced_weights, f"WITH {FLOWS} SELECT subtype, round((SELECT count(*) FROM flows) / ((SELECT count(DISTINCT subtype) FROM flows) * count(*))::DOUBLE, 6) AS weight FROM flows GROUP BY subtype"),
    "grow_exact": (grow_exact, _exact_sql()),
    "learning_curve": (learning_curve, _CURVE),
    "train_rf_classifier": (train_rf_classifier, None),
    "train_rf_regressor": (train_rf_regressor, None),
    "gini_importance": (gini_importance, None),
    "federated_train": (federated_train, None),
    "friedman1": (friedman1, None),
    "synthetic_classification": (synthetic_classification, None),
    "separate_features": (separate_features, None),
}
