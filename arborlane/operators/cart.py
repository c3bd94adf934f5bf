"""Exact CART for many trees at once: by levels where a node has many rows, and a task each where it has few.

* Every tree has a seed of its own.  How often a tree draws a row is a Poisson
  number by the hash of seed and key, taken in the scan, so a tree is the same
  whichever trees are grown with it and however rows are dealt.
* Rows that are equal in every feature go the same way in a tree.  Where there
  are few different ones, one scan sums them by tree and features, and all
  levels read these sums instead of the rows; the trees are the same.
* A level is one job over all trees: the scan walks rows down what is grown so
  far and sums them by (tree, node, feature, value) for the features that the
  node tries; running sums over ranges of values give the gain of every
  threshold halfway between two values.  No bins, no window over a whole node
  or feature.
* Nodes of at most `local` rows wait; when no larger one is left, the rows of
  each go to one task, which grows the whole subtree.  So the number of jobs is
  the depth at which nodes are small, and depth itself has no bound.
* A split is the largest gain (relative to the node's impurity, in steps of
  2**-30), then the lowest feature, then the lowest threshold.  A node tries
  `tries` features in an order by hash of seed and node; if none of them can
  split it, the next ones.

Sums of classes are whole numbers, so classifiers don't depend on the order of
rows at all.  Sums of a regressor's targets are doubles: gains that differ by
less than a step compare equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import unused
from ..schemas import Hyperparameters
from ..session import discard, scratch
from . import packed

#: Rows of a node that one task may finish; rows of a range of values; values from which ranges are taken; ranges at most.
LOCAL, RANGE_ROWS, RANGE_SAMPLE, MOST_RANGES = 200_000, 1_000_000, 100_000, 4096
#: Steps of the relative gain.
STEPS = float(1 << 30)
#: Numbers within a subtree that one task grows, and nodes of a level, as bits of a node's number.
SUBTREE_BITS, LEVEL_BITS = 19, 30
BIG, SMALL, SPLIT, LEAF = "big", "small", "split", "leaf"
STATE = "tree_id long, node_id long, depth int, tries int, state string, feature long, threshold double, left long, right long, support long, sums array<double>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


@dataclass(frozen=True)
class Tree:
    """number, seed and, in a sharded forest, the shard whose rows it may draw."""

    tree_id: int
    seed: int
    shard: object = None


@dataclass(frozen=True)
class Rules:
    kind: str  # gini, entropy or variance
    weights: tuple[float, ...]  # of the classes; three ones for sums of a regressor: weight, target, its square
    features: int
    tries: int
    min_split: int
    depth: int | None
    local: int

    def order(self, seed: int, node: int) -> np.ndarray:
        """Features in the order in which a node tries them."""
        x = np.array([seed % 2**64], np.uint64) * _A ^ np.array([node % 2**64], np.uint64) * _B
        x = (x ^ (x >> np.uint64(31))) + np.arange(1, self.features + 1, dtype=np.uint64) * _C
        x = (x ^ (x >> np.uint64(30))) * _B
        return np.argsort((x ^ (x >> np.uint64(27))) * _C, kind="stable")

    def impurity(self, sums: np.ndarray) -> np.ndarray:
        """Of rows of sums: the impurity times the weight."""
        if self.kind == "variance":
            return sums[:, 2] - sums[:, 1] * sums[:, 1] / sums[:, 0]
        own = [sums[:, i] * w for i, w in enumerate(self.weights)]
        total = own[0].copy()
        for c in own[1:]:
            total = total + c
        if self.kind == "gini":
            squares = own[0] * own[0]
            for c in own[1:]:
                squares = squares + c * c
            return total - squares / total
        out = np.zeros(len(sums))
        for c in own:
            with np.errstate(divide="ignore", invalid="ignore"):
                out = out + np.where(c > 0, -c * np.log(c / total), 0.0)
        return out

    def impurity_sql(self, c: list[Column]) -> Column:
        """The same, in the same order, in the JVM."""
        if self.kind == "variance":
            return c[2] - c[1] * c[1] / c[0]
        own = [x * F.lit(w) for x, w in zip(c, self.weights, strict=True)]
        total = sum(own[1:], own[0])
        if self.kind == "gini":
            return total - sum((x * x for x in own[1:]), own[0] * own[0]) / total
        return sum((F.when(x > 0, -x * F.ln(x / total)).otherwise(0.0) for x in own), F.lit(0.0))

    def pure(self, sums: np.ndarray) -> bool:
        if self.kind == "variance":
            return bool(self.impurity(sums[None])[0] <= 1e-12 * sums[2])
        return int((sums > 0).sum()) < 2

    def pure_sql(self, c: list[Column]) -> Column:
        if self.kind == "variance":
            return self.impurity_sql(c) <= 1e-12 * c[2]
        return sum(((x > 0).cast("int") for x in c), F.lit(0)) < 2


def rules(request: Hyperparameters, features: int, weights: tuple[float, ...] = (1.0, 1.0), local: int | None = None) -> Rules:
    """Rules of a request; max_features is sqrt, log2, onethird, all, a share (with a point) or a number."""
    asked = request.features_each_split
    own = {"sqrt": math.sqrt(features), "log2": math.log2(features or 1), "onethird": features / 3, "all": features, "auto": features}.get(asked)
    if own is None:
        own = float(asked) * features if "." in asked else int(asked)
    kind = (request.criterion if request.criterion in ("gini", "entropy") else "gini") if request.tree_type == "classifier" else "variance"
    return Rules(kind, weights if kind != "variance" else (1.0, 1.0, 1.0), features, min(max(1, int(own)), max(1, features)), request.min_samples_split, request.max_depth, local or LOCAL)


def split(rule: Rules, x: np.ndarray, sums: np.ndarray) -> tuple[int, float] | None:
    """(gain in steps, threshold) of the best cut of one feature; sums has a row for each x.  None if all values are equal."""
    order = np.argsort(x, kind="stable") if rule.kind != "variance" else np.lexsort((sums[:, 1], x))
    x, sums = x[order], sums[order]
    cut = np.flatnonzero(x[1:] != x[:-1])
    if not len(cut):
        return None
    upto = np.cumsum(sums, axis=0)
    left, total = upto[cut], upto[-1]
    parent = rule.impurity(total[None])[0]
    q = np.floor((1.0 - (rule.impurity(left) + rule.impurity(total - left)) / parent) * STEPS + 0.5)
    k = int(np.argmax(q))
    low, high = float(x[cut[k]]), float(x[cut[k] + 1])
    middle = (low + high) / 2
    return int(q[k]), middle if middle < high else low


def subtree(rule: Rules, seed: int, tree: int, node: int, depth: int, x: np.ndarray, sums: np.ndarray, count: np.ndarray | None = None) -> list[tuple]:
    """Rows of STATE for the whole subtree below a node, itself included, from all of its rows; `count`: how many rows each stands for, one without it."""
    count = np.ones(len(x), np.int64) if count is None else count
    out, waiting, used = [], [(node, depth, np.arange(len(x)))], 0
    while waiting:
        at, level, rows = waiting.pop()
        own, total, n, best = sums[rows], sums[rows].sum(axis=0), int(count[rows].sum()), None
        if not (n < rule.min_split or rule.pure(total) or (rule.depth is not None and level >= rule.depth)):
            order = rule.order(seed, at)
            for k in range(0, rule.features, rule.tries):
                for f in sorted(order[k : k + rule.tries].tolist()):
                    found = split(rule, x[rows, f], own)
                    if found and (best is None or found[0] > best[0]):
                        best = (found[0], f, found[1])
                if best:
                    break
        if best is None:
            out.append((tree, at, level, 0, LEAF, None, None, None, None, n, total.tolist()))
            continue
        _, f, threshold = best
        goes = x[rows, f] <= threshold
        left, right = node + used + 1, node + used + 2
        used += 2
        out.append((tree, at, level, 0, SPLIT, f, threshold, left, right, n, total.tolist()))
        waiting += [(left, level + 1, rows[goes]), (right, level + 1, rows[~goes])]
    return out


def _states(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class Growing:
    """What is grown so far, from the tables of the levels; the latest row of a node counts."""

    def __init__(self, levels: list[str]):
        names = {"tree_id": pa.int64(), "node_id": pa.int64(), "depth": pa.int32(), "tries": pa.int32(), "state": pa.string(), "feature": pa.int64(), "threshold": pa.float64(), "left": pa.int64(), "right": pa.int64()}
        tables = [packed.dataset([p]).to_table(columns=list(names)).cast(pa.schema(names)) for p in levels]
        level = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
        table = pa.concat_tables(tables)
        tree, node = (table.column(c).to_numpy() for c in ("tree_id", "node_id"))
        order = np.lexsort((level, node, tree))
        last = np.ones(len(order), bool)
        last[:-1] = (tree[order][1:] != tree[order][:-1]) | (node[order][1:] != node[order][:-1])
        table = table.take(pa.array(np.sort(order[last])))
        self.trees = packed.Trees(table)
        order = np.lexsort((table.column("node_id").to_numpy(), table.column("tree_id").to_numpy()))
        self.state = np.array(table.column("state").to_pylist(), object)[order]
        self.depth, self.tries = table.column("depth").to_numpy()[order], table.column("tries").to_numpy()[order]


def drawn_times(request: Hyperparameters, trees: list[Tree], key: str, shard: str | None = None) -> Column:
    """An array of how often each tree draws the row."""
    from .forest import drawn

    def times(t: Tree) -> Column:
        own = drawn(float(request.max_samples), t.seed, key).cast("int") if request.bootstrap else F.lit(1)
        return own if shard is None else F.when(F.col(f"`{shard}`").eqNullSafe(F.lit(t.shard)), own).otherwise(0)

    return F.array(*[times(t) for t in trees])


def class_sizes(df: DataFrame, request: Hyperparameters) -> dict[int, int]:
    """Rows of each class; labels are whole numbers from 0 on."""
    return {r[0]: r[1] for r in df.groupBy(F.col(f"`{request.target}`").cast("long")).count().collect() if r[0] is not None}  # a row for each class


def class_weights(found: dict[int, int], request: Hyperparameters) -> tuple[float, ...]:
    """A weight for each class from 0 to the largest label; n / (classes * rows of the class) if balanced."""
    width = max(2, max(found) + 1)
    if request.class_weight != "balanced":
        return (1.0,) * width
    n = sum(found.values())
    return tuple(n / (len(found) * found[k]) if k in found else 1.0 for k in range(width))


def _ranges(rows: DataFrame, n: int, features: int, seed: int) -> list[list[float]]:
    """For each feature the bounds of ranges of about RANGE_ROWS rows, from a bounded sample; where they lie changes no result."""
    ranges = min(MOST_RANGES, math.ceil(n / RANGE_ROWS))
    if ranges < 2:
        return [[] for _ in range(features)]
    some = rows.sample(min(1.0, RANGE_SAMPLE / n), seed).select(*[f"f{i}" for i in range(features)]).limit(2 * RANGE_SAMPLE).toPandas().to_numpy()
    return [np.unique(np.quantile(some[:, i], np.arange(1, ranges) / ranges, method="nearest")).tolist() if len(some) else [] for i in range(features)]


def grow(df: DataFrame, request: Hyperparameters, features: list[str], key: str, trees: list[Tree], shard: str | None = None, local: int | None = None) -> DataFrame:
    """The node table (as `forest.NODES`) of all trees.

    Null features count as 0, NaN as more than any number; rows without a
    target are left out; repeated rows (with ids of their own) count as often;
    rows of one id are drawn together; a table without rows raises ValueError.  A tree whose sample is empty is one
    leaf of support 0.  A leaf's support is its distinct rows.
    """
    spark, classifier = df.sparkSession, request.tree_type == "classifier"
    sizes = class_sizes(df, request) if classifier else {0: df.where(F.col(f"`{request.target}`").isNotNull()).count()}
    n = sum(sizes.values())
    if not n:
        raise ValueError("no rows to grow trees on")
    rule = rules(request, len(features), class_weights(sizes, request) if classifier else (1.0, 1.0, 1.0), local)
    m, seeds, numbers = len(rule.weights), [t.seed for t in trees], [t.tree_id for t in trees]
    (times,) = unused(df, "times")
    values = [F.nanvl(c, F.lit(math.inf)).alias(f"f{i}") for i, c in enumerate(packed.inputs(features))]
    target = F.col(f"`{request.target}`").cast("long" if classifier else "double")
    rows = df.where(F.col(f"`{request.target}`").isNotNull()).select(drawn_times(request, trees, key, shard).alias(times), target.cast("double").alias("y"), *values)
    base = scratch(spark, "growing")
    inputs = [f"f{i}" for i in range(len(features))]
    few = n > rule.local and bool(inputs) and len(trees) * rows.agg(F.approx_count_distinct(F.xxhash64(*inputs))).first()[0] <= n
    if few:
        w, y = F.col("w"), F.col("y")
        own = [w, w * y, w * y * y] if not classifier else [F.when(y == i, w).otherwise(0) for i in range(m)]
        drawn = rows.select(F.posexplode(times).alias("t", "w"), "y", *inputs).where(w > 0)
        sums = drawn.groupBy("t", *inputs).agg(F.count("*").alias("n"), *[F.sum(c.cast("double")).alias(f"s{i}") for i, c in enumerate(own)])
        sums.write.parquet(f"{base}/distinct")
        rows = spark.read.parquet(f"{base}/distinct").select("t", "n", *[f"s{i}" for i in range(m)], *inputs)
    bounds = _ranges(rows, rows.count() if few else n, len(features), seeds[0])
    level = 0

    def place(k: int) -> str:
        return f"{base}/level-{k}"

    start = BIG if n > rule.local else SMALL
    roots = [(t, 0, 0, 0, start, None, None, None, None, None, None) for t in numbers]
    spark.createDataFrame(roots, STATE).coalesce(1).write.parquet(place(0))

    def reached(b: pa.RecordBatch, growing: Growing, state: str) -> Iterator[tuple]:
        """(tree's place, where its rows are, x, how many rows each stands for, sums) of the rows that lie in a node of the state."""
        if few:
            place, x = b.column(0).to_numpy(zero_copy_only=False), packed.matrix(b, 2 + m, len(features))
            count, sums = b.column(1).to_numpy(zero_copy_only=False), packed.matrix(b, 2, m)
        else:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(numbers))
            y, x = b.column(1).to_numpy(zero_copy_only=False), packed.matrix(b, 2, len(features))
        for t, number in enumerate(numbers):
            live = np.flatnonzero(place == t if few else w[:, t] > 0)
            at = growing.trees.leaf(number, x[live])
            here = growing.state[at] == state
            if here.any():
                own = live[here]
                yield t, at[here], x[own], *((count[own], sums[own]) if few else (np.ones(len(own), np.int64), row_sums(y[own], w[own, t])))

    def row_sums(y: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = w.astype(np.float64)
        if not classifier:
            return np.column_stack([w, w * y, w * y * y])
        out = np.zeros((len(y), m))
        out[np.arange(len(y)), y.astype(np.int64)] = w
        return out

    def sums_of(levels: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            growing, orders = Growing(levels), {}
            for b in batches:
                parts = []
                for t, at, x, count, sums in reached(b, growing, BIG):
                    for node in np.unique(at).tolist():
                        if node not in orders:
                            k = growing.tries[node] * rule.tries
                            orders[node] = rule.order(seeds[t], int(growing.trees.node[node]))[k : k + rule.tries]
                    tried = np.full((len(at), rule.tries), -1)
                    for node in np.unique(at).tolist():
                        tried[at == node, : len(orders[node])] = orders[node]
                    for j in range(rule.tries):
                        ok = np.flatnonzero(tried[:, j] >= 0)
                        f = tried[ok, j]
                        parts.append((np.full(len(f), numbers[t]), growing.trees.node[at[ok]], f, x[ok, f], count[ok], sums[ok]))
                if not parts:
                    continue
                tree, node, f, x, one, sums = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.lexsort((x, f, node, tree))
                tree, node, f, x, one, sums = tree[order], node[order], f[order], x[order], one[order], sums[order]
                first = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]) | (f[1:] != f[:-1]) | (x[1:] != x[:-1])]))
                part = np.array([0] * len(first), np.int32)
                for i in range(len(features)):
                    own = f[first] == i
                    part[own] = np.searchsorted(bounds[i], x[first][own], "right")
                totals = np.add.reduceat(sums, first, axis=0)
                arrays = [pa.array(v) for v in (tree[first], node[first], f[first], part, x[first], np.add.reduceat(one, first), *totals.T)]
                yield pa.RecordBatch.from_arrays(arrays, ["tree_id", "node_id", "feature", "part", "x", "n", *[f"s{i}" for i in range(m)]])

        return run

    names = ["n", *[f"s{i}" for i in range(m)]]
    schema = ", ".join(["tree_id long, node_id long, feature long, part int, x double, n long", *[f"s{i} double" for i in range(m)]])

    def grown(levels: list[str], k: int) -> DataFrame:
        """The next level's table: what became of each big node, and its children."""
        of_node, of_feature, of_range = ["tree_id", "node_id"], ["tree_id", "node_id", "feature"], ["tree_id", "node_id", "feature", "part"]
        sums = rows.mapInArrow(sums_of(levels), schema).repartition(*of_range)
        sums = sums.groupBy(*of_range, "x").agg(*[F.sum(c).alias(c) for c in names])
        group = W.partitionBy(*of_range).orderBy("x")  # a range of a feature's values in a node
        runs = sums.select(*of_range, "x", F.lead("x").over(group).alias("next"), *[F.sum(c).over(group.rowsBetween(W.unboundedPreceding, 0)).alias(f"own_{c}") for c in names])
        ends = sums.groupBy(*of_range).agg(F.min("x").alias("low"), *[F.sum(c).alias(c) for c in names])
        along = W.partitionBy(*of_feature).orderBy("part")  # a row for each range
        ends = ends.select(*of_range, F.lead("low").over(along).alias("after"), *[F.coalesce(F.sum(c).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"before_{c}") for c in names], *[F.sum(c).over(W.partitionBy(*of_feature)).alias(f"all_{c}") for c in names])
        left = {c: F.col(f"own_{c}") + F.col(f"before_{c}") for c in names}
        cuts = runs.join(ends, of_range).select(*of_feature, "x", F.coalesce("next", "after").alias("next"), *[v.alias(f"left_{c}") for c, v in left.items()], *[F.col(f"all_{c}") for c in names])
        low, high = [F.col(f"left_s{i}") for i in range(m)], [F.col(f"all_s{i}") - F.col(f"left_s{i}") for i in range(m)]
        whole = [F.col(f"all_s{i}") for i in range(m)]
        gain = F.floor((1.0 - (rule.impurity_sql(low) + rule.impurity_sql(high)) / rule.impurity_sql(whole)) * STEPS + 0.5)
        middle = (F.col("x") + F.col("next")) / 2
        threshold = F.when(middle < F.col("next"), middle).otherwise(F.col("x"))
        may = F.col("next").isNotNull() & ~rule.pure_sql(whole) & (F.col("all_n") >= rule.min_split)
        best = F.when(may, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-threshold).alias("t"), F.col("left_n").alias("n"), F.array(*low).alias("sums")))
        found = cuts.groupBy(*of_node).agg(F.max(best).alias("best"), F.first("all_n").alias("n"), F.array(*[F.first(c) for c in (f"all_s{i}" for i in range(m))]).alias("sums"))
        waiting = spark.read.parquet(place(k)).where(F.col("state") == BIG).select(*of_node, "depth", "tries")
        each = waiting.join(found, of_node, "left").withColumn("rank", F.row_number().over(W.partitionBy("tree_id", F.col("best").isNotNull()).orderBy("node_id")) - 1)  # large nodes of one level
        column = lambda name: [F.element_at(name, i + 1) for i in range(m)]
        stops = F.coalesce(rule.pure_sql(column("sums")) | (F.col("n") < rule.min_split), F.lit(True))
        again = ~stops & (F.lit(rule.tries) * (F.col("tries") + 1) < rule.features)
        number = lambda side: F.shiftleft(F.lit(k + 1).cast("long"), LEVEL_BITS + SUBTREE_BITS) + F.shiftleft((2 * F.col("rank") + side).cast("long"), SUBTREE_BITS)

        def node(state, number=F.col("node_id"), depth=F.col("depth"), tries=F.lit(0), feature=F.lit(None), threshold=F.lit(None), left=F.lit(None), right=F.lit(None), support=F.col("n"), sums=F.col("sums")) -> Column:
            own = dict(node_id=number, depth=depth, tries=tries, state=state, feature=feature, threshold=threshold, left=left, right=right, support=support, sums=sums)
            kinds = dict(f.split() for f in STATE.split(", "))
            return F.struct(*[v.cast(kinds[c]).alias(c) for c, v in own.items()])

        def child(side: int, n: Column, sums: Column) -> Column:
            deep = F.col("depth") + 1
            ends = rule.pure_sql([F.element_at(sums, i + 1) for i in range(m)]) | (n < rule.min_split) | (F.lit(False) if rule.depth is None else deep >= rule.depth)
            return node(F.when(ends, LEAF).when(n <= rule.local, SMALL).otherwise(BIG), number(side), deep, support=n, sums=sums)

        b = F.col("best")
        rest = F.zip_with("sums", b["sums"], lambda whole, left: whole - left)
        made = F.array(node(F.lit(SPLIT), feature=-b["f"], threshold=-b["t"], left=number(0), right=number(1)), child(0, b["n"], b["sums"]), child(1, F.col("n") - b["n"], rest))
        stays = F.array(node(F.when(again, BIG).otherwise(LEAF), tries=F.when(again, F.col("tries") + 1).otherwise(0)))
        return each.select("tree_id", F.explode(F.when(b.isNotNull(), made).otherwise(stays)).alias("node")).select("tree_id", "node.*")

    while (level or start == BIG) and spark.read.parquet(place(level)).where(F.col("state") == BIG).limit(1).count():
        grown([place(k) for k in range(level + 1)], level).write.parquet(place(level + 1))
        level += 1
    levels = [place(k) for k in range(level + 1)]
    at_seed = dict(zip(numbers, seeds, strict=True))

    def waiting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of the small nodes."""
        growing = Growing(levels)
        for b in batches:
            for t, at, x, count, sums in reached(b, growing, SMALL):
                flat = np.column_stack([count, sums, x])
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), numbers[t])), pa.array(growing.trees.node[at]), pa.array(growing.depth[at].astype(np.int32)), values], ["tree_id", "node_id", "depth", "values"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        tree, node, depth = (own[0].column(k)[0].as_py() for k in range(3))
        flat = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in own]).reshape(-1, 1 + m + len(features))
        count, sums, x = flat[:, 0].astype(np.int64), flat[:, 1 : 1 + m], np.ascontiguousarray(flat[:, 1 + m :])
        if not classifier:  # sums of doubles in one order, however the rows came
            order = np.lexsort((*sums.T, *x.T))
            count, sums, x = count[order], sums[order], x[order]
        yield _states(subtree(rule, at_seed[tree], tree, node, depth, x, sums, count))

    small = rows.mapInArrow(waiting_rows, "tree_id long, node_id long, depth int, values array<double>")
    finished = small.groupBy("tree_id", "node_id").applyInArrow(finish, STATE)  # at most `local` rows each
    states = spark.read.parquet(*levels)
    done = states.where(F.col("state").isin(SPLIT, LEAF)).unionByName(finished)
    if start == SMALL:  # a tree whose sample is empty has no row to finish
        empty = states.where(F.col("state") == SMALL).join(finished.select("tree_id").distinct(), "tree_id", "left_anti")
        done = finished.unionByName(empty.withColumns({"state": F.lit(LEAF), "support": F.lit(0).cast("long"), "sums": F.array(*[F.lit(0.0)] * m)}))
    shares = [F.element_at("sums", i + 1) * F.lit(w) for i, w in enumerate(rule.weights)]
    total = sum(shares[1:], shares[0])
    dist = F.array(*[F.coalesce(F.try_divide(c, total), F.lit(0.0)) for c in shares]) if classifier else F.array(F.coalesce(F.try_divide(F.element_at("sums", 2), F.element_at("sums", 1)), F.lit(0.0)))
    leaf = F.col("state") == LEAF
    out = scratch(spark, "nodes")
    nodes = done.select("tree_id", "node_id", "feature", "threshold", "left", "right", F.when(leaf, F.coalesce("support", F.lit(0))).cast("long").alias("support"), F.when(leaf, dist).alias("dist"))
    nodes.write.parquet(out)
    discard(spark, base)
    return spark.read.parquet(out)
