"""Feature selection: constant features, out-of-bag permutation importance, rank correlation, Ward clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import exact_rank, hash32, unused
from ..functions.ranking import running_sums
from . import packed
from .forest import left_out

#: Fixed values of the reference: importances up to here go; clusters are cut at this distance.
LEAST_IMPORTANCE, CUT = 0.0, 0.3
#: Rows of a bucket in which values are permuted; the part of all rows from which a value's ranks are broadcast.
BUCKET_ROWS, SHARE = 500_000, 1024


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """feature and its sample variance (null for a single row), in one pass."""
    wide = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(features)])).alias("f")).select("f.*")


def constant_features(df: DataFrame, features: list[str]) -> list[str]:
    return [r.feature for r in variances(df, features).where("variance = 0").collect()]


def spearman(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, rho for a <= b: correlation of average ranks over the rows that have both values; null without variance.

    All features rank together: one table of (rank list, value, rows) is summed
    and ranked by ranges, ranks go back to rows by value, and rows' vectors of
    ranks are multiplied in tasks into sums for all pairs.  So the number of
    shuffles does not hang on the number of features.  A feature with nulls
    adds, for each other feature, a list of its ranks among the rows that the
    first one has.  Ranks of values that more than 1/`SHARE` of all rows share
    (fewer than `SHARE` in a list) are broadcast, so no value is a hot key.
    NaN counts as null.  An empty table gives null correlations.
    """
    f = len(features)
    values = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(features)])
    known = values.agg(F.count("*").alias("n"), *[F.count(f"x{i}").alias(f"x{i}") for i in range(f)]).first()
    lacking = [i for i in range(f) if known[f"x{i}"] < known["n"]]
    lists = [(i, j) for i in range(f) for j in (-1, *(k for k in lacking if k != i))]
    at = {p: k for k, p in enumerate(lists)}
    pairs = [(i, j, at[i, j if j in lacking and i != j else -1], at[j, i if i in lacking and i != j else -1]) for i in range(f) for j in range(i, f)]
    each = F.array(*[F.when(F.lit(True) if j < 0 else F.col(f"x{j}").isNotNull(), F.struct(F.lit(k).alias("list"), F.col(f"x{i}").alias("x"))) for k, (i, j) in enumerate(lists)])
    long = values.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode(F.filter(each, lambda e: e["x"].isNotNull())).alias("e")).select("row", "e.list", "e.x")
    counts = long.groupBy("list", "x").agg(F.count("*").alias("n"))
    ranks = running_sums(counts, "x", {"upto": "n"}, by=("list",)).select("list", "x", "n", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    hot = ranks.where(F.col("n") > max(known["n"] // SHARE, 1)).select("list", "x", F.col("rank").alias("hot"))  # fewer than SHARE in a list
    long = long.join(F.broadcast(hot), ["list", "x"], "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("row"), F.lit(1024)) + 1).otherwise(0))
    ranked = long.join(ranks.select("list", "x", "rank", F.lit(0).cast("long").alias("salt")), ["list", "x", "salt"], "left")
    vectors = ranked.select("row", F.struct("list", F.coalesce("hot", "rank").alias("rank")).alias("e")).groupBy("row").agg(F.collect_list("e").alias("e"))  # one of each list

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 6))
        for b in batches:
            entries, wide = b.column(0), np.full((b.num_rows, len(lists)), np.nan)
            flat = entries.flatten()
            row = np.repeat(np.arange(b.num_rows), entries.value_lengths().to_numpy(zero_copy_only=False))
            wide[row, flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
            for k, (_, _, p, q) in enumerate(pairs):
                ok = ~np.isnan(wide[:, p]) & ~np.isnan(wide[:, q])
                u, v = wide[ok, p], wide[ok, q]
                total[k] += (len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), *[pa.array(c) for c in total.T]], ["pair", "n", "u", "v", "uu", "vv", "uv"])

    sums = vectors.select("e").mapInArrow(products, "pair long, n double, u double, v double, uu double, vv double, uv double")
    sums = sums.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "u", "v", "uu", "vv", "uv")])
    c = {k: F.col(k) for k in ("n", "u", "v", "uu", "vv", "uv")}
    spread = F.sqrt(c["n"] * c["uu"] - c["u"] * c["u"]) * F.sqrt(c["n"] * c["vv"] - c["v"] * c["v"])
    rho = F.when(spread > 0, (c["n"] * c["uv"] - c["u"] * c["v"]) / spread)
    names = df.sparkSession.createDataFrame([(k, features[i], features[j]) for k, (i, j, *_) in enumerate(pairs)], "pair long, a string, b string")
    return names.join(sums, "pair", "left").select("a", "b", rho.alias("rho"))


def matrix(pairs: DataFrame, features: list[str]) -> np.ndarray:
    """The symmetric matrix of a few features' correlations; missing ones count as 0."""
    at = {c: i for i, c in enumerate(features)}
    out = np.eye(len(features))
    for r in pairs.collect():
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = 1.0 if r.a == r.b else (0.0 if r.rho is None or np.isnan(r.rho) else r.rho)
    return out


def ward_clusters(correlation: np.ndarray, cut: float = CUT) -> list[int]:
    """Cluster numbers (from 0, by first member) of features at distance 1 - |rho|, merged by Ward's rule while the distance is at most the cut."""
    n = len(correlation)
    d = 1 - np.abs(correlation)
    np.fill_diagonal(d, np.inf)
    size, member = np.ones(n), {i: [i] for i in range(n)}
    while len(member) > 1:
        i, j = sorted(divmod(int(np.argmin(d)), n))
        if d[i, j] > cut:
            break
        for k in member:
            if k not in (i, j):
                total = size[i] + size[j] + size[k]
                d[i, k] = d[k, i] = np.sqrt(((size[i] + size[k]) * d[i, k] ** 2 + (size[j] + size[k]) * d[j, k] ** 2 - size[k] * d[i, j] ** 2) / total)
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        member[i] += member.pop(j)
    out = [0] * n
    for number, key in enumerate(sorted(member, key=lambda k: min(member[k]))):
        for i in member[key]:
            out[i] = number
    return out


def representatives(features: list[str], clusters: list[int], importance: dict[str, float]) -> tuple[list[str], list[str]]:
    """(kept, dropped): the most important feature of each cluster stays, the first name among equals."""
    best: dict[int, str] = {}
    for name, c in sorted(zip(features, clusters, strict=True)):
        if c not in best or importance.get(name, 0.0) > importance.get(best[c], 0.0):
            best[c] = name
    kept = [f for f in features if f in set(best.values())]
    return kept, [f for f in features if f not in kept]


def with_next(df: DataFrame, seed: int | str, key: str, columns: list[str], names: list[str]) -> DataFrame:
    """df with `names`: the columns' values of the next row in the order of hash and key; the last row has the first one's.

    Hash order is random, so each column is permuted at random, by one cycle
    through all rows.  Rows shuffle once, into buckets of about BUCKET_ROWS;
    a bucket's last row gets its values from a table of the buckets' first rows.
    """
    h, part, next_, first = unused(df, "h", "part", "next", "first")
    buckets = max(1, math.ceil(df.count() / BUCKET_ROWS))
    rows = df.withColumn(h, hash32(seed, F.col(f"`{key}`"))).withColumn(part, F.floor(F.col(h) * F.lit(buckets) / F.lit(1 << 32)).cast("long")).repartition(F.col(part))
    own = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    firsts = rows.groupBy(part).agg(F.min_by(own, F.struct(F.col(h), F.col(f"`{key}`"))).alias(first))
    along = W.partitionBy(F.lit(0)).orderBy(part)  # a row for each bucket
    firsts = firsts.select(part, F.coalesce(F.lead(first).over(along), F.first(first).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias(first))
    rows = rows.withColumn(next_, F.lead(own).over(W.partitionBy(part).orderBy(h, F.col(f"`{key}`"))))
    out = rows.join(firsts, part).withColumn(next_, F.coalesce(next_, first))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(next_)[n].alias(n) for n in names])


def permuted(df: DataFrame, seed: int | str, key: str, columns: list[str], names: list[str], seeds: list[str]) -> DataFrame:
    """df with `names`: each column's values in a random order of its own.

    The row of rank r by one hash of the key has the value of the row of rank r
    by another; both hashes hang on the column's seed.  All ranks of all columns are
    taken in one shuffle and met in a second one, and no task has all rows of
    either; a row's values then return to it by its key, which is unique.
    """
    list_, value, feature, place, size, side = unused(df, "list", "value", "feature", "place", "size", "side")
    entries = [F.struct(F.lit(f"{seed}-{n}-{s}").alias(list_), F.lit(i).alias(feature), F.lit(s).alias(side), (F.col(f"`{c}`") if s == "b" else F.lit(None)).cast("double").alias(value)) for i, (c, n) in enumerate(zip(columns, seeds, strict=True)) for s in "ab"]
    (e,) = unused(df, "entry")
    long = df.select(F.col(f"`{key}`"), F.explode(F.array(*entries)).alias(e)).select(F.col(f"`{key}`"), f"{e}.*")
    ranked = exact_rank(long, F.col(list_), key, (list_,), place, size)
    met = ranked.groupBy(feature, place).agg(F.min_by(f"`{key}`", side).alias(key), F.max_by(value, side).alias(value))  # one row of each side
    back = met.groupBy(F.col(f"`{key}`")).agg(*[F.max(F.when(F.col(feature) == i, F.col(value))).alias(n) for i, n in enumerate(names)])
    return df.join(back, key)


def permutation_importance(df: DataFrame, nodes: DataFrame, out_of: tuple[list[int], Column], features: list[str], key: str, target: str, seed: int = 123) -> DataFrame:
    """feature and importance: the mean over trees of (permuted error - error) / error * 100 on rows out of the tree's bag.

    out_of: tree numbers and an array of how often each drew a row.  Every
    feature is permuted on its own (`permuted`, whose seeds name the feature),
    and judged with the others as they were.  `key` is unique.
    A tree scores a row once, and once more for each feature that it uses;
    errors are summed where rows are scored.  Trees without error are skipped.
    """
    f = len(features)
    x, moved = unused(df, *[f"f{i}" for i in range(f)]), unused(df, *[f"g{i}" for i in range(f)])
    y, times = unused(df, "y", "times")
    numbers, groups, folder = out_of[0], packed.groups(nodes), packed.publish(nodes)
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{target}`").cast("double").alias(y), out_of[1].alias(times), *[c.alias(n) for c, n in zip(packed.inputs(features), x, strict=True)])
    rows = permuted(rows, seed, key, x, moved, features).select(y, times, *x, *moved)
    sums = None
    for group in groups:

        def run(batches: Iterator[pa.RecordBatch], group: list[int] = group) -> Iterator[pa.RecordBatch]:
            own = packed.trees(folder, group)
            used = {t: sorted(own.features_used(t)) for t in own.roots}
            tree, feature, n, error = [], [], [], []
            for b in batches:
                truth, here, there = b.column(0).to_numpy(zero_copy_only=False), packed.matrix(b, 2, f), packed.matrix(b, 2 + f, f)
                votes = left_out(b, 1, numbers)
                for t in own.roots:
                    out = np.flatnonzero(votes[t])
                    some = here[out]
                    for k in (-1, *used[t]):
                        moving = some
                        if k >= 0:
                            moving = some.copy()
                            moving[:, k] = there[out, k]
                        dist = own.dist[own.leaf(t, moving)]
                        wrong = dist.argmax(axis=1) != truth[out] if dist.shape[1] > 1 else (dist[:, 0] - truth[out]) ** 2
                        tree.append(t)
                        feature.append(k)
                        n.append(len(out))
                        error.append(float(wrong.sum()))
                if len(tree) > 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tree, feature, n, error)], ["tree_id", "feature", "n", "error"])
                    tree, feature, n, error = [], [], [], []
            if tree:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (tree, feature, n, error)], ["tree_id", "feature", "n", "error"])

        part = rows.mapInArrow(run, "tree_id long, feature long, n long, error double")
        sums = part if sums is None else sums.union(part)
    if sums is None:
        raise ValueError("no trees")
    each = sums.groupBy("tree_id", "feature").agg((F.sum("error") / F.sum("n")).alias("error"))  # a row for each tree and feature
    whole = W.partitionBy("tree_id")  # the features of one tree
    each = each.withColumn("base", F.max(F.when(F.col("feature") < 0, F.col("error"))).over(whole)).where("base > 0")
    trees = each.where("feature < 0").agg(F.count("*").alias("trees"))
    change = each.where("feature >= 0").groupBy("feature").agg(F.sum((F.col("error") - F.col("base")) / F.col("base") * 100).alias("change"))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "at long, name string")
    out = names.join(change, F.col("at") == F.col("feature"), "left").join(F.broadcast(trees))  # one row
    return out.select(F.col("name").alias("feature"), F.try_divide(F.coalesce("change", F.lit(0.0)), F.col("trees")).alias("importance"))


def cut(importance: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    return importance.where(F.col("importance") > least)


def watchlist(importance: DataFrame, names: list[str], top: int = 20) -> DataFrame:
    """The top features by importance, with a flag for watched names."""
    return importance.orderBy(F.desc("importance"), "feature").limit(top).withColumn("watched", F.col("feature").isin(names))


class Selector:
    """Constant features, then unimportant ones, then all but one of each cluster go; summaries are kept for each max_features."""

    def __init__(self, least: float = LEAST_IMPORTANCE, distance: float = CUT):
        self.least, self.distance = least, distance
        self.cache: dict = {}

    def fit(self, df: DataFrame, features: list[str], importance: dict[str, float], max_features: str = "sqrt") -> dict:
        """A summary: kept, dropped by reason, and scores; computed once for each max_features."""
        if max_features not in self.cache:
            constant = constant_features(df, features)
            rest = [f for f in features if f not in constant]
            weak = [f for f in rest if importance.get(f, 0.0) <= self.least]
            rest = [f for f in rest if f not in weak]
            kept, redundant = representatives(rest, ward_clusters(matrix(spearman(df, rest), rest), self.distance), importance) if rest else ([], [])
            self.cache[max_features] = {"kept": kept, "constant": constant, "unimportant": weak, "redundant": redundant, "scores": {f: importance.get(f, 0.0) for f in features}}
        return self.cache[max_features]
