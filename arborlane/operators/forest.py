"""Forests: bootstrap weights, split search, growing with MLlib, node tables and scoring.

A tree is rows of a node table: tree_id, node_id, feature (its index, null at a
leaf), threshold, left, right, support (rows of a leaf) and dist (class
probabilities, or one value).  Rows go left where x <= threshold.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import exact_rank, hash32, uniform, unused
from ..functions.ranking import running_sums
from ..schemas import Hyperparameters
from ..session import exists, shared_folder
from . import packed
from .clean import separate

NODES = "tree_id long, node_id long, feature long, threshold double, left long, right long, support long, dist array<double>"
#: MLlib's own bound on depth.
DEEPEST = 30
#: Trees of the forest that ranks features; draws of one row at most (a Poisson number of mean 1 is larger with a chance of 3e-15).
PRELIMINARY, MOST_DRAWS = 20, 16


def bootstrap_weights(df: DataFrame, key: str, trees: int, max_samples: float = 1.0, seed: int = 123) -> DataFrame:
    """tree_id, key and weight (how often the row is drawn, 0 included: out of bag).

    Each tree draws int(max_samples * n) rows with replacement; a draw is a
    hash of (seed + tree, its number), so a tree's sample is always the same.
    Draws are counted before they meet the rows.
    """
    rows = exact_rank(df.select(key), seed, key, (), "__at", "__n")
    n = df.count()
    draws = df.sparkSession.range(trees * int(max_samples * n)).select((F.col("id") % trees).alias("tree_id"), F.floor(F.col("id") / trees).cast("long").alias("draw"))
    at = F.pmod(hash32(F.col("tree_id") + seed, "draw"), F.lit(max(n, 1))) + 1
    drawn = draws.select("tree_id", at.alias("__at")).groupBy("tree_id", "__at").agg(F.count("*").alias("w"))
    each = rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))).alias("tree_id"), key, "__at")
    return each.join(drawn, ["tree_id", "__at"], "left").select("tree_id", key, F.coalesce("w", F.lit(0)).cast("long").alias("weight"))


def with_times(df: DataFrame, key: str, trees: int, max_samples: float = 1.0, seed: int = 123, name: str = "times") -> DataFrame:
    """df with an array of how often each tree draws the row: the weights of `bootstrap_weights`, tree by tree."""
    at, size, tree, w = unused(df, "at", "size", "tree_id", "w")
    n = df.count()
    draws = df.sparkSession.range(trees * int(max_samples * n)).select((F.col("id") % trees).alias(tree), F.floor(F.col("id") / trees).cast("long").alias("draw"))
    place = F.pmod(hash32(F.col(tree) + seed, "draw"), F.lit(max(n, 1))) + 1
    drawn = draws.select(tree, place.alias(at)).groupBy(at).agg(F.array(*[F.count_if(F.col(tree) == t).cast("int") for t in range(trees)]).alias(w))
    rows = exact_rank(df, seed, key, (), at, size).join(drawn, at, "left")
    return rows.withColumn(name, F.coalesce(w, F.array(*[F.lit(0)] * trees))).drop(at, size, w)


def impurity(kind: str, n: Column, s: Column, ss: Column | None = None) -> Column:
    """Of n rows with s positives (gini, entropy) or sum s and squares ss (variance)."""
    p = s / n
    if kind == "gini":
        return 2 * p * (1 - p)
    if kind == "entropy":
        part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(0.0)
        return part(p) + part(1 - p)
    return ss / n - p * p


def best_splits(df: DataFrame, features: list[str], target: str, kind: str = "gini", node: str | None = None) -> DataFrame:
    """For each feature (and node) the threshold of largest gain, halfway between two values, and the gain; the lowest threshold among equals.

    One row for each feature and distinct value is summed first; running sums
    go by ranges of values, and a value finds the next one by the rows before
    it.  Exact: no bins, and no task has all values of a feature.
    """
    by = [node] if node else []
    y, n, s, ss, x, f = unused(df, "y", "n", "s", "ss", "x", "feature")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(f), F.col(f"`{c}`").cast("double").alias(x)) for c in features])).alias("pair")
    long = df.select(*by, F.col(f"`{target}`").cast("double").alias(y), pairs).select(*by, y, "pair.*").where(F.col(x).isNotNull())
    values = long.groupBy(*by, f, x).agg(F.count("*").alias(n), F.sum(y).alias(s), F.sum(F.col(y) * F.col(y)).alias(ss))
    runs = running_sums(values, x, {"ln": n, "ls": s, "lss": ss}, by=(*by, f))
    totals = values.groupBy(*by, f).agg(F.sum(n).alias("tn"), F.sum(s).alias("ts"), F.sum(ss).alias("tss"))
    after = runs.select(*[F.col(c).alias(f"after_{i}") for i, c in enumerate((*by, f))], F.col(x).alias("next"), (F.col("ln") - F.col(n)).alias("before"))
    meets = [F.col(c).eqNullSafe(F.col(f"after_{i}")) for i, c in enumerate((*by, f))]
    same = [F.col(c).eqNullSafe(F.col(f"of_{i}")) for i, c in enumerate((*by, f))]
    totals = totals.select(*[F.col(c).alias(f"of_{i}") for i, c in enumerate((*by, f))], "tn", "ts", "tss")
    runs = runs.join(after, reduce(lambda a, b: a & b, meets) & (F.col("ln") == F.col("before"))).join(F.broadcast(totals) if node is None else totals, reduce(lambda a, b: a & b, same))
    c = {k: F.col(k) for k in ("ln", "ls", "lss", "tn", "ts", "tss")}
    rn, rs, rss = c["tn"] - c["ln"], c["ts"] - c["ls"], c["tss"] - c["lss"]
    gain = impurity(kind, c["tn"], c["ts"], c["tss"]) - (c["ln"] * impurity(kind, c["ln"], c["ls"], c["lss"]) + rn * impurity(kind, rn, rs, rss)) / c["tn"]
    scored = runs.select(*by, F.col(f).alias("feature"), ((F.col(x) + F.col("next")) / 2).alias("threshold"), F.round(gain, 9).alias("gain"))
    return scored.groupBy(*by, "feature").agg(F.min_by(F.struct("threshold", "gain"), F.struct(-F.col("gain"), F.col("threshold"))).alias("b")).select(*by, "feature", "b.*")


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """df with n / (classes * rows of the class)."""
    own, n = unused(df, "class", "size")
    sizes = df.groupBy(F.col(f"`{target}`").alias(own)).agg(F.count("*").alias(n))
    whole = W.partitionBy(F.lit(0))  # a row for each class
    sizes = sizes.select(own, (F.sum(n).over(whole) / (F.count("*").over(whole) * F.col(n))).alias(name))
    return df.join(F.broadcast(sizes), F.col(f"`{target}`").eqNullSafe(F.col(own))).drop(own)


def train(df: DataFrame, request: Hyperparameters, features: list[str], seed: int = 123, weight: str | None = None):
    """An MLlib forest; `weight` names a column of weights, rows of weight 0 are left out.

    Depth is capped at 30, MLlib's bound; min_samples_split s becomes s // 2
    rows in a leaf at least, as MLlib has no least size of a split.
    """
    classifier = request.tree_type == "classifier"
    rows = df
    if classifier and request.class_weight == "balanced" and not weight:
        (weight,) = unused(df, "weight")
        rows = balanced_weights(df, request.target, weight)
    if weight:
        rows = rows.where(F.col(weight) > 0)
    table = separate(rows, request.target, features)
    if weight:
        from pyspark.ml.feature import VectorAssembler

        safe = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)], F.col(f"`{request.target}`").cast("double").alias("label"), F.col(weight).cast("double").alias("w"))
        table = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(safe).select("features", "label", "w")
    maker = RandomForestClassifier if classifier else RandomForestRegressor
    own = {"impurity": request.criterion if request.criterion in ("gini", "entropy") else "gini"} if classifier else {}
    forest = maker(
        featuresCol="features",
        labelCol="label",
        numTrees=request.n_estimators,
        maxDepth=min(request.max_depth or DEEPEST, DEEPEST),
        minInstancesPerNode=max(1, request.min_samples_split // 2),
        subsamplingRate=float(request.max_samples),
        bootstrap=request.bootstrap,
        featureSubsetStrategy=request.features_each_split,
        maxMemoryInMB=512,
        cacheNodeIds=True,
        seed=seed,
        **own,
    )
    if weight:
        forest = forest.setWeightCol("w")
    return forest.fit(table)


def node_table(model, first_tree: int = 0, folder: str | None = None) -> DataFrame:
    """An MLlib model's trees as rows; its saved form is read back, so the trees never pass the driver."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    folder = folder or f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    n, split = F.col("nodeData"), F.col("nodeData.split")
    stats = n["impurityStats"]
    classifier = "numClasses" in dir(model) and model.__class__.__name__.endswith("ClassificationModel")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    dist = F.transform(stats, lambda s: F.coalesce(F.try_divide(s, total), F.lit(0.0))) if classifier else F.array(n["prediction"])
    leaf = n["leftChild"] < 0
    return data.select(
        (F.col("treeID") + first_tree).cast("long").alias("tree_id"),
        n["id"].cast("long").alias("node_id"),
        F.when(~leaf, split["featureIndex"]).cast("long").alias("feature"),
        F.when(~leaf, F.element_at(split["leftCategoriesOrThreshold"], 1)).alias("threshold"),
        F.when(~leaf, n["leftChild"]).cast("long").alias("left"),
        F.when(~leaf, n["rightChild"]).cast("long").alias("right"),
        F.when(leaf, n["rawCount"]).cast("long").alias("support"),
        F.when(leaf, dist).alias("dist"),
    )


def _results(df: DataFrame, nodes: DataFrame, features: list[str], carry: list[str], run_of, schema: str, draws: Column | None = None) -> tuple[DataFrame, bool]:
    """Rows of the carried columns and what run_of(trees, batch, x) makes of a batch, for each group of trees; and whether there are several groups.

    draws, an array, comes after the carried columns.
    """
    groups = packed.groups(nodes)
    folder, n = packed.publish(nodes) if groups else "", len(carry) + (draws is not None)
    rows = df.select(*[F.col(f"`{c}`") for c in carry], *([] if draws is None else [draws.alias(unused(df, "draws")[0])]), *packed.inputs(features))
    out = None
    for group in groups:

        def run(batches: Iterator[pa.RecordBatch], group: list[int] = group) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from run_of(packed.trees(folder, group), b, packed.matrix(b, n, len(features)))

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no trees")
    return out, len(groups) > 1


def left_out(b: pa.RecordBatch, at: int, numbers: list[int]) -> dict[int, np.ndarray]:
    """For each tree, which rows of the batch it did not draw; the array at a column has a number for each of `numbers`."""
    times = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(numbers))
    return {t: times[:, i] == 0 for i, t in enumerate(numbers)}


def _fields(df: DataFrame, names: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).ravel()))


def score(df: DataFrame, nodes: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, tree_id, support and dist of every row in every tree.  Rows stay where they are; tasks read the trees.  A null feature counts as 0."""

    def each(own: packed.Trees, b: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for tree in own.roots:
            at = own.leaf(tree, x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(at), tree)), pa.array(own.support[at]), _lists(own.dist[at])], [key, "tree_id", "support", "dist"])

    return _results(df, nodes, features, [key], each, f"{_fields(df, [key])}, tree_id long, support long, dist array<double>")[0]


def vote_sums(df: DataFrame, nodes: DataFrame, features: list[str], key: str, width: int, cap: int | None = None, carry: tuple[str, ...] = (), out_of: tuple[list[int], Column] | None = None) -> DataFrame:
    """key, carried columns, trees, weight and sums (of dist, position by position) over all trees, for every row.

    Rows are summed where they are scored, so nothing leaves Python but one row
    for each, and nothing shuffles unless the trees come in several groups.
    Columns to carry go through the scan too, so that no result is joined back.
    cap: trees weigh as much as their leaf's rows up to it; without it, one
    each.  out_of: tree numbers and an array of how often each drew the row; a
    tree votes for the rows that it did not draw.  `key` is unique.
    """
    names, numbers = [key, *carry], out_of[0] if out_of else None

    def each(own: packed.Trees, b: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        most = min(width, own.dist.shape[1])
        sums, weight, trees = np.zeros((b.num_rows, width)), np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
        votes = left_out(b, len(names), numbers) if numbers else None
        for tree in own.roots:
            rows = slice(None) if votes is None else np.flatnonzero(votes[tree])
            at = own.leaf(tree, x[rows])
            w = np.ones(len(at)) if cap is None else np.minimum(own.support[at], cap).astype(np.float64)
            weight[rows] += w
            trees[rows] += 1
            sums[rows, :most] += w[:, None] * own.dist[at, :most]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(trees), pa.array(weight), _lists(sums)], [*names, "trees", "weight", "sums"])

    out, several = _results(df, nodes, features, names, each, f"{_fields(df, names)}, trees long, weight double, sums array<double>", out_of and out_of[1])
    if several:
        totals = [F.sum(F.get("sums", F.lit(k))) for k in range(width)]
        kept = [F.first(F.col(f"`{c}`")).alias(c) for c in carry]
        out = out.groupBy(key).agg(*kept, F.sum("trees").alias("trees"), F.sum("weight").alias("weight"), F.array(*totals).alias("sums"))
    return out


def oob_votes(votes: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """The votes of trees for rows that they didn't draw."""
    return votes.join(weights.where("weight = 0").select("tree_id", key), ["tree_id", key])


def oob_curve(votes: DataFrame, weights: DataFrame, truth: DataFrame, key: str, y: str, steps: list[int], include_uncovered: bool = False) -> DataFrame:
    """trees, covered and error of the first so many trees' out-of-bag votes, from a table of votes.

    A row's votes meet once, as a list by tree whose running sums are read at
    every step.  Rows that no tree covers yet are left out (or count as errors
    with include_uncovered).  `learning_curve` does the same where rows are scored.
    """
    own = oob_votes(votes, weights, key).select(key, F.struct("tree_id", F.element_at("dist", 2).alias("p")).alias("v"))
    rows = own.groupBy(key).agg(F.collect_list("v").alias("v")).join(truth.select(key, y), key)  # a vote of each tree

    def at(step: int) -> Column:
        some = F.filter("v", lambda v: v["tree_id"] < step)
        mean = F.aggregate(some, F.lit(0.0), lambda total, v: total + v["p"]) / F.size(some)
        return F.struct(F.when(F.size(some) > 0, 1).otherwise(0).alias("covered"), F.when((F.size(some) > 0) & ((mean > 0.5).cast("int") != F.col(y)), 1).otherwise(0).alias("wrong"))

    each = rows.select(*[at(s).alias(f"s{i}") for i, s in enumerate(steps)])
    sums = each.agg(*[F.sum(f"s{i}.{c}").alias(f"{c}{i}") for i in range(len(steps)) for c in ("covered", "wrong")])
    return _curve(sums, truth.agg(F.count("*").alias("total")) if include_uncovered else None, steps)


def _curve(sums: DataFrame, total: DataFrame | None, steps: list[int]) -> DataFrame:
    """A row for each step of one row of covered0, wrong0, ...; steps that cover nothing are left out."""
    if total is not None:
        sums = sums.crossJoin(total)  # one row each
    each = F.array(*[F.struct(F.lit(s).cast("long").alias("trees"), F.col(f"covered{i}").cast("long").alias("covered"), F.col(f"wrong{i}").cast("long").alias("wrong")) for i, s in enumerate(steps)])
    rows = sums.select(F.explode(each).alias("e"), *([] if total is None else ["total"])).where("e.covered > 0")
    error = F.col("e.wrong") / F.col("e.covered") if total is None else (F.col("e.wrong") + F.col("total") - F.col("e.covered")) / F.col("total")
    return rows.select("e.trees", "e.covered", error.alias("error"))


def learning_curve(df: DataFrame, nodes: DataFrame, features: list[str], key: str, y: str, out_of: tuple[list[int], Column], steps: list[int], include_uncovered: bool = False) -> DataFrame:
    """trees, covered and error of the first so many trees' out-of-bag votes, in one scan of the rows.

    A row's running sums over its trees stay in the task, which passes on two
    numbers for each step.  Only if the trees come in several groups are a
    row's sums at the steps added by key first: sums up to a step add up over
    groups.  Rows that no tree covers yet are left out, or count as errors with
    include_uncovered.
    """
    n, numbers = len(steps), out_of[0]
    several = len(packed.groups(nodes)) > 1

    def each(own: packed.Trees, b: pa.RecordBatch, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        votes, sums, count = left_out(b, 2, numbers), np.zeros((b.num_rows, n)), np.zeros((b.num_rows, n))
        for tree in own.roots:
            rows = np.flatnonzero(votes[tree])
            first = int(np.searchsorted(by_step, tree, "right"))  # the first step that takes the tree in
            p = own.dist[own.leaf(tree, x[rows]), 1]
            if first < n:
                sums[rows, first] += p
                count[rows, first] += 1
        sums, count = np.cumsum(sums, axis=1)[:, back], np.cumsum(count, axis=1)[:, back]
        if several:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(sums), _lists(count)], [key, y, "sums", "counts"])
            return
        with np.errstate(invalid="ignore"):
            wrong = (count > 0) & ((sums / count > 0.5) != (b.column(1).to_numpy(zero_copy_only=False)[:, None] == 1))
        totals = np.column_stack([(count > 0).sum(0), wrong.sum(0)]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in totals], names)

    order = np.argsort(steps, kind="stable")
    by_step, back = np.array(steps)[order], np.argsort(order)
    names = [f"{c}{i}" for i in range(n) for c in ("covered", "wrong")]
    schema = f"{_fields(df, [key, y])}, sums array<double>, counts array<double>" if several else ", ".join(f"{c} long" for c in names)
    rows, _ = _results(df, nodes, features, [key, y], each, schema, out_of[1])
    if several:
        own = rows.groupBy(key).agg(F.first(y).alias(y), *[F.sum(F.get("sums", F.lit(i))).alias(f"p{i}") for i in range(n)], *[F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(n)])
        covers = [F.col(f"n{i}") > 0 for i in range(n)]
        wrong = [c & ((F.col(f"p{i}") / F.col(f"n{i}") > 0.5).cast("int") != F.col(y)) for i, c in enumerate(covers)]
        sums = own.agg(*[F.count_if(v).alias(f"{c}{i}") for i in range(n) for c, v in (("covered", covers[i]), ("wrong", wrong[i]))])
    else:
        sums = rows.agg(*[F.sum(c).alias(c) for c in names])
    return _curve(sums, df.agg(F.count("*").alias("total")) if include_uncovered else None, steps)


def with_importances(model, features: list[str], top: int = 15) -> list[tuple[str, float, float]]:
    """(feature, impurity importance, running share) of the top features."""
    order = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:top]
    out, total = [], 0.0
    for name, value in order:
        total += value
        out.append((name, value, total))
    return out


#: The search space and the regressor's defaults of the reference.
SEARCH = {
    "n_estimators": [10, 20, 30, 40, 60, 80, 100, 150, 200],
    "max_features": ["sqrt", "log2"],
    "criterion": ["gini", "entropy"],
    "max_samples": [0.3, 0.5, 0.7, 0.8, 1.0],
}
REGRESSOR = {"tree_type": "regressor", "max_depth": None, "min_samples_split": 2, "max_samples": 0.3, "max_features": "onethird"}


def drawn(rate: float, seed: int | str, key: str) -> Column:
    """How often a bag draws the row: a Poisson number of mean `rate` by the hash of seed and key.  The scan draws, nothing is joined."""
    steps, below, term = [], 0.0, float(np.exp(-rate))
    for k in range(1, MOST_DRAWS + 1):
        below += term
        steps.append(below)
        term *= rate / k
    # the hash is bound by a lambda, so that it is taken once
    return F.element_at(F.transform(F.array(uniform(seed, key)), lambda u: sum(((u >= x).cast("int") for x in steps), F.lit(0))), 1)


@dataclass
class Grown:
    """A forest, its trees' numbers, and an array of how often each tree drew a row."""

    nodes: DataFrame
    numbers: list[int]
    times: Column

    @property
    def out_of(self) -> tuple[list[int], Column]:
        return self.numbers, self.times


def grow_forest(df: DataFrame, request: Hyperparameters, features: list[str], key: str, seed: int = 123) -> Grown:
    """All trees of a request, each with its own seed and bootstrap sample."""
    from . import cart
    from .sampling import tree_seed

    trees = [cart.Tree(t, tree_seed(seed, t)) for t in range(request.n_estimators)]
    return Grown(cart.grow(df, request, features, key, trees), [t.tree_id for t in trees], cart.drawn_times(request, trees, key))


def tree_weights(df: DataFrame, grown: Grown, key: str) -> DataFrame:
    """tree_id, key and weight of every row for every tree, as bootstrap_weights gives."""
    each = F.arrays_zip(F.array(*[F.lit(t).cast("long") for t in grown.numbers]).alias("tree_id"), grown.times.alias("weight"))
    return df.select(key, F.explode(each).alias("e")).select("e.tree_id", key, F.col("e.weight").cast("long").alias("weight"))


def out_of_bag(df: DataFrame, grown: Grown, features: list[str], key: str, target: str) -> DataFrame:
    """key, y, p and yhat of the rows that a tree at least left out, by those trees; one scan."""
    from .voting import from_sums

    (y,) = unused(df, "y")
    voted = vote_sums(df.withColumn(y, F.col(f"`{target}`").cast("long")), grown.nodes, features, key, 2, carry=(y,), out_of=grown.out_of).where("trees > 0")
    return from_sums(voted, key, [0, 1], carry=(y,)).select(key, F.element_at("probs", 2).alias("p"), F.col("yhat").cast("long").alias("yhat"), F.col(y).alias("y"))


TRIALS = "trial long, setting string, score double"


def search(df: DataFrame, features: list[str], key: str, target: str, trials: int = 60, seed: int = 123, space: dict | None = None, depth: int | None = None, selector=None, table: str | None = None) -> list[tuple[float, dict]]:
    """(out-of-bag F1, settings) of so many trials, the best first; `tpe.suggest` names each from those before it.

    table: a folder that takes each trial when it is scored; a search that was
    lost goes on after the trials there.  With a `selection.Selector` each
    value of max_features has features of its own, chosen once by a preliminary
    forest's out-of-bag permutation importance; its `cache` keeps the choices.
    """
    from .metrics import binary_metrics
    from .selection import permutation_importance
    from .tpe import suggest

    spark, space = df.sparkSession, space or SEARCH
    df = df.select(*[F.col(f"`{c}`") for c in (key, *features, target)])
    history: list[tuple[dict, float]] = []
    if table and exists(spark, table):
        history = [(json.loads(r.setting), r.score) for r in spark.read.schema(TRIALS).json(table).orderBy("trial").limit(trials).collect()]

    def chosen(max_features: str) -> list[str]:
        if selector is None:
            return features
        if max_features not in selector.cache:
            grown = grow_forest(df, Hyperparameters(n_estimators=PRELIMINARY, max_depth=depth, target_column=target, max_features=max_features), features, key, seed)
            found = permutation_importance(df, grown.nodes, grown.out_of, features, key, target, seed)
            selector.fit(df, features, {r["feature"]: r["importance"] or 0.0 for r in found.collect()}, max_features)
        return selector.cache[max_features]["kept"] or features

    while len(history) < trials and (setting := suggest(history, space, seed)) is not None:
        own = chosen(setting.get("max_features", "sqrt"))
        grown = grow_forest(df, Hyperparameters(max_depth=depth, target_column=target, **setting), own, key, seed)
        f1 = binary_metrics(out_of_bag(df, grown, own, key, target)).first()["f1"]
        if table:
            spark.createDataFrame([(len(history), json.dumps(setting), f1)], TRIALS).coalesce(1).write.mode("append").json(table)
        history.append((setting, f1))
    if selector is not None and history:  # the best trial's features, also where its trial was read back
        chosen(max(history, key=lambda t: t[1])[0].get("max_features", "sqrt"))
    return sorted([(score, setting) for setting, score in history], key=lambda x: (-x[0], str(x[1])))
