"""Training by shard and evaluation over shards.

A shard is a column here.  Its rows may be read by any executor: the statistics
of training where the data lies are reproduced, its privacy isn't.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unused
from ..operators import cart, forest, metrics, sampling, voting
from ..operators.clean import DAY
from ..schemas import Hyperparameters, TrainingRequest
from ..sources import files


@dataclass
class ShardForest:
    nodes: DataFrame
    quotas: dict
    classes: list


def prepare_shards(df: DataFrame, key: str, shard: str, target: str, ratio: float = 1.0, seed: int = 123) -> DataFrame:
    """Every shard's rows after the validation carve and undersampling, with `part`, in one plan for all shards.

    A shard without a minority, or with one too small to lose rows, keeps all
    its rows for training.
    """
    own, ones, zeros, kept_in, a, b = unused(df, "__shard", "__ones", "__zeros", "__in", "__a", "__b")
    counts = df.groupBy(F.col(shard).alias(own)).agg(F.count_if(F.col(target) == 1).alias(ones), F.count_if(F.col(target) == 0).alias(zeros))
    minor = F.least(ones, zeros)
    rows = sampling.split_by_rank(df, key, (shard, target), sampling.VALIDATION_SHARE, f"{seed}-val", "part", "validation", "train")
    rows = rows.join(counts, F.col(shard).eqNullSafe(F.col(own))).withColumn("part", F.when(minor < 2, "train").otherwise(F.col("part")))
    kept = rows.where("part = 'train'").groupBy(F.col(shard).alias(kept_in)).agg(F.count_if(F.col(target) == 1).alias(a), F.count_if(F.col(target) == 0).alias(b))
    most = sampling.half_even(F.least(a, b) * ratio)
    ranked, r, s = sampling.ranked_by(rows, key, (shard, target, "part"), seed)
    ranked = ranked.join(kept, F.col(shard).eqNullSafe(F.col(kept_in)), "left")
    major = F.when(F.col(a) > F.col(b), 1).otherwise(0)
    keep = (F.col("part") == "validation") | (minor == 0) | (F.least(a, b) == 0) | (F.col(target) != major) | (F.col(r) <= most)
    return ranked.where(keep).drop(own, ones, zeros, kept_in, a, b, r, s)


def provision(df: DataFrame, path: str, key: str, workers: int, strategy: str = "iid", day: str | None = None, target: str = "Label", force: bool = False, seed: int = 123) -> dict:
    """Shards with a train and a test part each, as Parquet by split and shard, and their manifest, which is written last.

    strategy: `iid`, or `by_day` with a day column.  Provisioned folders are
    left as they are unless `force`; their manifest comes back.
    """
    spark = df.sparkSession
    if not force and files.exists(spark, f"{path}/manifest"):
        return files.read_json(spark, f"{path}/manifest")
    if strategy == "by_day" and not day:
        raise ValueError("by_day needs a day column")
    shards = sampling.shard_by_day(df, day, workers) if strategy == "by_day" else sampling.shard_iid(df, key, workers, seed)
    parts = sampling.split_by_rank(shards, key, ("shard_id", target), sampling.TEST_SHARE, seed)
    files.write_shards(parts, f"{path}/shards")
    manifest = {"partition_strategy": strategy, "day_column": day, "num_workers": workers}
    files.write_json(spark, f"{path}/manifest", manifest)
    return manifest


def train_shards(df: DataFrame, request: Hyperparameters, features: list[str], key: str, shard: str, seed: int = 123, equal: bool = False, table: str | None = None) -> ShardForest:
    """A forest in which each shard grows its quota of trees on its own rows; quotas follow shard sizes.

    All shards' trees grow in one plan.  table: a folder that takes each
    shard's trees as a part; parts that are complete there aren't grown again.
    """
    sizes = df.groupBy(shard).agg(F.count("*").alias("size"))
    quotas = {r[0]: r[1] for r in sampling.tree_quotas(sizes, request.n_estimators, shard, "size", equal).collect()}
    spark = df.sparkSession
    done = set(files.complete_parts(spark, table)) if table else set()
    kind = dict(df.dtypes)[shard]
    names, first, trees, of = sorted(quotas, key=lambda x: (x is None, str(x))), 0, [], {}
    for k, name in enumerate(names):
        of[k] = range(first, first + quotas[name])
        first += quotas[name]
        if k not in done:
            trees += [cart.Tree(t, sampling.tree_seed(seed, i, k), name) for i, t in enumerate(of[k])]
    grown = cart.grow(df, request, features, key, trees, shard) if trees else None
    parts = []
    for k, name in enumerate(names):
        if not len(of[k]):
            continue
        if k not in done:
            part = grown.where(F.col("tree_id").between(of[k][0], of[k][-1])).withColumn(shard, F.lit(name).cast(kind))
            if table:
                files.append_part(part, table, k)
            else:
                parts.append(part)
        if table:
            parts.append(spark.read.parquet(f"{table}/part={k}"))
    if table:
        files.purge_parts(spark, table, len(quotas))
    classes = sorted(r[0] for r in df.select(request.target).distinct().collect()) if request.tree_type == "classifier" else []
    return ShardForest(reduce(DataFrame.unionByName, parts), quotas, classes or [0, 1])


def prepare_job(df: DataFrame, request: TrainingRequest, key: str, ratio: float = 1.0, shard: str | None = None) -> DataFrame:
    """df with `shard_id` and `part` (test, validation, train), by the request's strategy; each shard is split, carved and cut by itself.

    shard: a column that names the shards already.  Raises KeyError for
    `by_day` without a day column.
    """
    h = request.hyperparameters
    if shard:
        rows = df.withColumnRenamed(shard, "shard_id")
    elif request.partition_strategy == "by_day":
        if DAY not in df.columns:
            raise KeyError(DAY)
        rows = sampling.shard_by_day(df, DAY, request.num_workers)
    else:
        rows = sampling.shard_iid(df, key, request.num_workers, request.seed)
    if h.tree_type == "regressor":
        return sampling.split_by_rank(rows, key, ("shard_id",), sampling.TEST_SHARE, request.seed, "part")
    rows = sampling.split_by_rank(rows, key, ("shard_id", h.target), sampling.TEST_SHARE, request.seed)
    rest = prepare_shards(rows.where("split = 'train'"), key, "shard_id", h.target, ratio, request.seed)
    return rows.where("split = 'test'").withColumn("part", F.lit("test")).unionByName(rest).drop("split")


def _voted(df: DataFrame, nodes: DataFrame, features: list[str], key: str, shard: str, target: str) -> DataFrame:
    """key, shard, y, probs and yhat by the leaf-weighted vote; shard and truth go through the scan that scores."""
    (y,) = unused(df, "y")
    sums = forest.vote_sums(df.withColumn(y, F.col(f"`{target}`").cast("long")), nodes, features, key, 2, voting.SUPPORT_CAP, (shard, y))
    return voting.from_sums(sums, key, [0, 1], (shard, y)).withColumnRenamed(y, "y")


def thresholds(held: DataFrame, nodes: DataFrame, features: list[str], key: str, shard: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(each shard's threshold, the pooled one) on validation rows, by the leaf-weighted vote."""
    rows = _voted(held, nodes, features, key, shard, target).select(key, shard, "y", F.element_at("probs", 2).alias("p"))
    return metrics.worker_thresholds(rows, shard), metrics.pooled_threshold(rows)


def by_shard(rows: DataFrame, found: DataFrame, shard: str) -> DataFrame:
    """rows (p, yhat) decided anew by their shard's threshold, where it has one."""
    of, t = unused(rows, "of", "t")
    at = F.broadcast(found.select(F.col(shard).alias(of), F.col("threshold").alias(t)))  # a row for each shard
    rows = rows.join(at, F.col(shard).eqNullSafe(F.col(of)), "left")
    return rows.withColumn("yhat", F.coalesce((F.col("p") >= F.col(t)).cast("long"), F.col("yhat"))).drop(of, t)


def evaluate_shards(df: DataFrame, nodes: DataFrame, features: list[str], key: str, shard: str, target: str, thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, metrics of each shard, their macro average) of the global forest on every shard's rows.

    Votes are weighted by leaf support.  thresholds: shard and threshold; a
    missing one means the class of larger probability.
    """
    rows = _voted(df, nodes, features, key, shard, target).withColumn("p", F.element_at("probs", 2))
    if thresholds is not None:
        (of,) = unused(rows, "of")
        few = F.broadcast(thresholds.select(F.col(shard).alias(of), F.col("threshold")))  # a row for each shard
        rows = rows.join(few, F.col(shard).eqNullSafe(F.col(of)), "left").drop(of).withColumn("yhat", F.when(F.col("threshold").isNull(), F.col("yhat")).otherwise((F.col("p") >= F.col("threshold")).cast("int")))
    each = metrics.worker_metrics(rows, shard)
    return rows, each, metrics.macro_average(each, ["accuracy", "precision", "recall", "f1", "auc"], "smallest")
