"""A whole centralized job: prepare, split, rebalance, grow, vote, calibrate, analyse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unused
from ..operators import cart, forest, metrics, sampling, voting
from ..schemas import Hyperparameters
from ..session import scratch
from ..sources import files


@dataclass
class Trained:
    nodes: DataFrame
    features: list[str]
    target: str
    threshold: float | None
    task: str
    weighted: bool = False  # trees vote by their leaves' support


def prepare(df: DataFrame, key: str, target: str, ratio: float = 1.0, seed: int = sampling.SEED) -> DataFrame:
    """df with `part`: test, validation, train, or dropped by undersampling; each row once."""
    split = sampling.split_by_rank(df, key, (target,), sampling.TEST_SHARE, seed)
    rest = sampling.split_by_rank(split.where("split = 'train'"), key, (target,), sampling.VALIDATION_SHARE, f"{seed}-val", "part", "validation", "train")
    train = sampling.undersample(rest.where("part = 'train'"), key, target, ratio, seed)
    names = [*df.columns, "part"]
    return split.where("split = 'test'").withColumn("part", F.lit("test")).select(names).unionByName(rest.where("part = 'validation'").select(names)).unionByName(train.select(names))


def train_rounds(rows: DataFrame, request: Hyperparameters, features: list[str], key: str, workers: int, seed: int, table: str) -> DataFrame:
    """The node table of a forest grown in rounds, each a part of `table`; rounds that are complete there aren't grown again.

    A tree is the same in whichever round it is grown.
    """
    spark = rows.sparkSession
    rounds = sampling.round_steps(request.n_estimators, workers)
    done = set(files.complete_parts(spark, table))
    for k, (start, end) in enumerate(rounds):
        if k not in done:
            trees = [cart.Tree(t, sampling.tree_seed(seed, t)) for t in range(start, end)]
            files.append_part(cart.grow(rows, request, features, key, trees), table, k)
    files.purge_parts(spark, table, len(rounds))
    return spark.read.parquet(table)


def scores(df: DataFrame, nodes: DataFrame, features: list[str], key: str, target: str) -> DataFrame:
    """key, y, p and yhat of every row; the truth goes through the scan that scores."""
    (y,) = unused(df, "y")
    voted = voting.from_sums(forest.vote_sums(df.withColumn(y, F.col(f"`{target}`").cast("long")), nodes, features, key, 2, carry=(y,)), key, [0, 1], (y,))
    return voted.select(key, F.element_at("probs", 2).alias("p"), F.col("yhat").cast("long").alias("yhat"), F.col(y).alias("y"))


def train_classifier(parts: DataFrame, request: Hyperparameters, features: list[str], key: str, seed: int = sampling.SEED) -> Trained:
    """Grows on `train`, takes the F1-max threshold of `validation`."""
    nodes = forest.grow_forest(parts.where("part = 'train'"), request, features, key, seed).nodes
    best = metrics.f1_threshold(metrics.curve(scores(parts.where("part = 'validation'"), nodes, features, key, request.target))).first()
    return Trained(nodes, features, request.target, best["threshold"] if best else None, "classifier")


def predict(df: DataFrame, trained: Trained, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carried columns, p, yhat (by the calibrated threshold), or key, carried columns and yhat of a regressor."""
    cap, kept = voting.SUPPORT_CAP if trained.weighted else None, [F.col(f"`{c}`") for c in carry]
    if trained.task == "regressor":
        return voting.mean_from_sums(forest.vote_sums(df, trained.nodes, trained.features, key, 1, cap, carry), key, carry)
    out = voting.from_sums(forest.vote_sums(df, trained.nodes, trained.features, key, 2, cap, carry), key, [0, 1], carry)
    if trained.threshold is not None:
        out = voting.with_threshold(out, trained.threshold, [0, 1])
    return out.select(key, *kept, F.element_at("probs", 2).alias("p"), F.col("yhat").cast("long").alias("yhat"))


def flagship(df: DataFrame, features: list[str], key: str, target: str, subtype: str, request: Hyperparameters) -> DataFrame:
    """Recall by subtype on the test part, at the threshold that validation gives; worst first."""
    folder = scratch(df.sparkSession, "parts")
    prepare(df, key, target).write.parquet(folder)
    parts = df.sparkSession.read.parquet(folder)
    trained = train_classifier(parts, request, features, key)
    (y,) = unused(parts, "y")
    test = parts.where("part = 'test'").withColumn(y, F.col(f"`{target}`").cast("long"))
    return metrics.misses_by(predict(test, trained, key, (subtype, y)).withColumnRenamed(y, "y"), subtype)
