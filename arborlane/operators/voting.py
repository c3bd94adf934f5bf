"""Votes of trees combined as aggregations over (row, tree, dist)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unused

#: Fixed value: a leaf's rows count up to here in weighted votes.
SUPPORT_CAP = 50


def long_votes(votes: DataFrame, key: str, classes: list) -> DataFrame:
    """key, tree_id, support, class and p; the i-th probability belongs to the i-th class."""
    named = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("class"), F.col("dist").alias("p"))
    return votes.select(key, "tree_id", "support", F.explode(named).alias("v")).select(key, "tree_id", "support", F.col("v.class").alias("class"), F.coalesce("v.p", F.lit(0.0)).alias("p"))


def aligned(votes: DataFrame, local: list, classes: list) -> DataFrame:
    """dist over the global classes for trees that know only the local ones; absent classes get 0."""
    at = {c: k for k, c in enumerate(local)}
    return votes.withColumn("dist", F.array(*[F.coalesce(F.get("dist", F.lit(at[c])), F.lit(0.0)) if c in at else F.lit(0.0) for c in classes]))


def _position_means(votes: DataFrame, key: str, weight: Column, width: int) -> DataFrame:
    """Weighted means of dist, position by position: partial sums in each task, no explode."""
    total = F.sum(weight)
    w, *names = unused(votes, "w", *[f"s{k}" for k in range(width)])
    sums = [F.sum(weight * F.coalesce(F.get("dist", F.lit(k)), F.lit(0.0))).alias(names[k]) for k in range(width)]
    rows = votes.groupBy(key).agg(total.alias(w), F.count("*").alias("trees"), *sums)
    base = F.when(F.col(w) == 0, 1.0).otherwise(F.col(w))
    return rows.select(key, "trees", F.array(*[F.col(s) / base for s in names]).alias("probs"))


def _decided(rows: DataFrame, classes: list) -> DataFrame:
    """yhat: the class of largest probability, the lowest class among equals."""
    top = F.array_position("probs", F.array_max("probs")).cast("int")
    return rows.withColumn("yhat", F.element_at(F.array(*[F.lit(c) for c in classes]), top))


def soft_vote(votes: DataFrame, key: str, classes: list) -> DataFrame:
    """key, trees, probs (means over trees) and yhat; classes in ascending order."""
    return _decided(_position_means(votes, key, F.lit(1.0), len(classes)), classes)


def leaf_weighted_vote(votes: DataFrame, key: str, classes: list, cap: int = SUPPORT_CAP) -> DataFrame:
    """Like `soft_vote`, trees weighted by their leaf's rows up to the cap; without any weight all is 0."""
    return _decided(_position_means(votes, key, F.least("support", F.lit(cap)).cast("double"), len(classes)), classes)


def from_sums(sums: DataFrame, key: str, classes: list, carry: tuple[str, ...] = ()) -> DataFrame:
    """The vote that `forest.vote_sums` already added up: key, carried columns, trees, probs and yhat."""
    base = F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight"))
    return _decided(sums.select(key, *[F.col(f"`{c}`") for c in carry], "trees", F.transform("sums", lambda s: s / base).alias("probs")), classes)


def mean_from_sums(sums: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The same of regression trees: key, carried columns, trees and yhat; 0 without any weight."""
    return sums.select(key, *[F.col(f"`{c}`") for c in carry], "trees", F.coalesce(F.try_divide(F.element_at("sums", 1), F.col("weight")), F.lit(0.0)).alias("yhat"))


def with_threshold(voted: DataFrame, threshold: float | Column, classes: list) -> DataFrame:
    """Binary only: the larger class where its probability reaches the threshold, else the smaller one."""
    if len(classes) != 2:
        raise ValueError("a threshold needs two classes")
    t = F.lit(float(threshold)) if isinstance(threshold, int | float) else threshold
    return voted.withColumn("yhat", F.when(F.element_at("probs", 2) >= t, F.lit(classes[1])).otherwise(F.lit(classes[0])))


def regression_mean(votes: DataFrame, key: str) -> DataFrame:
    """key, trees and yhat: the mean of the trees' values."""
    return votes.groupBy(key).agg(F.count("*").alias("trees"), F.avg(F.element_at("dist", 1)).alias("yhat"))


def leaf_weighted_regression(votes: DataFrame, key: str, cap: int = SUPPORT_CAP) -> DataFrame:
    w = F.least("support", F.lit(cap)).cast("double")
    return votes.groupBy(key).agg(F.count("*").alias("trees"), F.coalesce(F.try_divide(F.sum(w * F.element_at("dist", 1)), F.sum(w)), F.lit(0.0)).alias("yhat"))


def ensemble_status(votes: DataFrame, expected: int) -> DataFrame:
    """found, expected and status: COMPLETE, PARTIAL, or FAILED without any tree."""
    found = votes.agg(F.countDistinct("tree_id").alias("found"))
    return found.select("found", F.lit(expected).cast("long").alias("expected"), F.when(F.col("found") == 0, "FAILED").when(F.col("found") < expected, "PARTIAL").otherwise("COMPLETE").alias("status"))


def pooled_results(results: DataFrame, worker: str = "worker", p: str = "p") -> DataFrame:
    """All workers' rows; probabilities stay only if every worker gave them."""
    workers = results.groupBy(worker).agg(F.bool_or(F.col(p).isNotNull()).alias("gave")).agg(F.coalesce(F.bool_and("gave"), F.lit(False)).alias("all_gave"))
    return results.join(F.broadcast(workers)).withColumn(p, F.when(F.col("all_gave"), F.col(p))).drop("all_gave")  # one row
