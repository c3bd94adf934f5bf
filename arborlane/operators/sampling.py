"""Samples, splits, class rebalancing and shards, all by hash rank.

Sizes are exact.  Samples and splits compare each row with the hash at which
its group's part ends (`first_by_hash`), so no row shuffles.  Shards need the
ranks themselves: those come from `exact_rank`, which has a class or day with
most of the rows ranked by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cutoffs import first_by_hash
from ..functions.hashing import exact_rank, unused, hash32

#: Fixed values of the reference pipeline: share and seed of the test split, share of validation, rows kept of a day, shards of a classifier.
TEST_SHARE, SEED, VALIDATION_SHARE, DAY_TARGET, CLASSIFIER_SHARDS = 0.2, 123, 0.15, 200_000, 20


def ranked_by(df: DataFrame, key: str, by: tuple[str, ...], seed: int | str) -> tuple[DataFrame, str, str]:
    """df ranked by hash within `by`, and the names of the rank's and the group size's columns, which df itself doesn't have."""
    r, s = unused(df, "__r", "__s")
    return exact_rank(df, seed, key, by, r, s), r, s


def first_rows(df: DataFrame, key: str, by: tuple[str, ...], seed: int | str, wanted) -> DataFrame:
    """The first wanted(size) rows of each group by hash."""
    (chosen,) = unused(df, "chosen")
    return first_by_hash(df, seed, key, by, wanted, chosen).where(chosen).drop(chosen)


def half_even(x: Column) -> Column:
    """Rounded to whole numbers, halves to even, as a long."""
    return F.bround(x.cast("double")).cast("long")


def quota_sample(df: DataFrame, key: str, group: str, target: int, seed: int = SEED) -> DataFrame:
    """At most `target` rows of each group."""
    return first_rows(df, key, (group,), seed, lambda size: F.lit(target))


def fraction_sample(df: DataFrame, key: str, group: str, fraction: float, seed: int = SEED) -> DataFrame:
    """The same share of each source, its number of rows rounded."""
    return first_rows(df, key, (group,), seed, lambda size: half_even(size * fraction))


def day_fractions(df: DataFrame, group: str, target: int) -> DataFrame:
    """Each group's rows and the share that a target leaves of it: min(1, target / rows)."""
    return df.groupBy(group).agg(F.count("*").alias("n")).withColumn("fraction", F.least(F.lit(1.0), F.lit(float(target)) / F.col("n")))


def protected_rebalance(df: DataFrame, key: str, group: str, protected: list[str], is_benign: Column, target: int = DAY_TARGET, seed: int = SEED) -> DataFrame:
    """In protected groups all rows but benign ones stay, and benign ones up to the target; other groups keep up to the target of any."""
    (kind,) = unused(df, "kind")
    mine = F.col(group).isin(protected)
    rows = df.withColumn(kind, F.when(~F.coalesce(mine, F.lit(False)), F.lit(0)).when(is_benign, F.lit(1)).otherwise(F.lit(2)))
    others = df.where(mine & ~is_benign).groupBy(F.col(group)).agg(F.count("*")).collect()  # a row for each protected group
    room = F.lit(target)
    for name, n in others:
        room = F.when(F.col(group) == F.lit(name), max(0, target - n)).otherwise(room)
    return first_rows(rows, key, (group, kind), seed, lambda size: F.when(F.col(kind) == 2, size).when(F.col(kind) == 1, room).otherwise(target)).drop(kind)


def distribution(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).orderBy(group)


def stratified_split(df: DataFrame, key: str, target: str, share: float = TEST_SHARE, seed: int | str = SEED, name: str = "split", held: str = "test", rest: str = "train") -> DataFrame:
    """Each row's part: of each class round-half-even(share * n) rows are held out; classes of one row aren't.

    Raises KeyError without the target and ValueError for an empty table or one
    with fewer than two classes of two rows.
    """
    if target not in df.columns:
        raise KeyError(target)
    classes = [r[0] for r in df.groupBy(target).count().where("count > 1").limit(2).collect()]
    if len(classes) < 2:
        raise ValueError("fewer than two classes of at least two rows")
    return split_by_rank(df, key, (target,), share, seed, name, held, rest)


def split_by_rank(df: DataFrame, key: str, by: tuple[str, ...], share: float, seed: int | str, name: str = "split", held: str = "test", rest: str = "train") -> DataFrame:
    (chosen,) = unused(df, "chosen")
    rows = first_by_hash(df, seed, key, by, lambda size: F.when(size > 1, half_even(size * share)).otherwise(0), chosen)
    return rows.withColumn(name, F.when(F.col(chosen), held).otherwise(rest)).drop(chosen)


def random_split(df: DataFrame, key: str, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Not by class, for regression."""
    return split_by_rank(df, key, (), share, seed)


def validation_carve(train: DataFrame, key: str, target: str, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """Rows of the training part go to `validation`; done before undersampling."""
    return split_by_rank(train, key, (target,), share, f"{seed}-val", "part", "validation", "train")


def undersample(df: DataFrame, key: str, target: str, ratio: float, seed: int = SEED) -> DataFrame:
    """The majority class cut to round-half-even(minority * ratio) rows, if it has more.

    Raises KeyError without the target; ValueError for a ratio that isn't
    positive, labels other than 0 and 1, or an empty minority.
    """
    if target not in df.columns:
        raise KeyError(target)
    if ratio <= 0:
        raise ValueError("the ratio must be positive")
    counts = {r[0]: r[1] for r in df.groupBy(target).count().limit(3).collect()}
    if not set(counts) <= {0, 1}:
        raise ValueError(f"labels other than 0 and 1: {sorted(map(str, set(counts) - {0, 1}))}")
    if len(counts) < 2:
        raise ValueError("the minority is empty")
    major = max(counts, key=lambda k: (counts[k], -k))
    most = half_even(F.lit(float(counts[1 - major])) * ratio)
    return first_rows(df, key, (target,), seed, lambda size: F.when(F.col(target) == major, most).otherwise(size))


def shard_iid(df: DataFrame, key: str, shards: int, seed: int = SEED) -> DataFrame:
    """Contiguous pieces of ceil(n / shards) rows; the last ones may be short or empty."""
    ranked, r, s = ranked_by(df, key, (), seed)
    return ranked.withColumn("shard_id", F.floor((F.col(r) - 1) / F.ceil(F.col(s) / F.lit(shards))).cast("long")).drop(r, s)


def shard_by_day(df: DataFrame, day: str, shards: int) -> DataFrame:
    """Whole days in turn, in their text order."""
    (own,) = unused(df, "__day")
    days = df.select(F.col(day).alias(own)).distinct()
    days = days.withColumn("shard_id", ((F.dense_rank().over(W.orderBy(own)) - 1) % shards).cast("long"))  # a row for each day
    return df.join(days, df[day].eqNullSafe(days[own])).drop(own)


def near_equal(rank: Column, size: Column, pieces: int) -> Column:
    """The piece (from 0) of a rank if the first size % pieces pieces get one more."""
    small, more = F.floor(size / pieces).cast("long"), size % pieces
    return F.when(rank <= more * (small + 1), F.floor((rank - 1) / (small + 1))).otherwise(more + F.floor((rank - 1 - more * (small + 1)) / F.greatest(small, F.lit(1)))).cast("long")


def shard_stratified(df: DataFrame, key: str, target: str, shards: int = CLASSIFIER_SHARDS, seed: int = SEED) -> DataFrame:
    """Near-equal pieces of each class."""
    ranked, r, s = ranked_by(df, key, (target,), seed)
    return ranked.withColumn("shard_id", near_equal(F.col(r), F.col(s), shards)).drop(r, s)


def shard_plain(df: DataFrame, key: str, shards: int, seed: int = SEED) -> DataFrame:
    """Near-equal pieces of all rows, for regression."""
    ranked, r, s = ranked_by(df, key, (), seed)
    return ranked.withColumn("shard_id", near_equal(F.col(r), F.col(s), shards)).drop(r, s)


def shard_count(tree_type: str, live_workers: int) -> int:
    return CLASSIFIER_SHARDS if tree_type == "classifier" else max(1, live_workers)


def assign_shards(shards: DataFrame, tasks: DataFrame, workers: int) -> DataFrame:
    """shard_id, task_id: a task trains on the shards with its own number modulo the workers.

    Raises ValueError if a shard would have no task.
    """
    out = shards.join(tasks, F.col("shard_id") % workers == F.col("task_id") % workers).select("shard_id", "task_id")
    if shards.join(out, "shard_id", "left_anti").limit(1).count():
        raise ValueError("fewer tasks than workers leave shards without a task")
    return out


def absolute_sample(df: DataFrame, key: str, target: str, rows: int, seed: int = SEED) -> DataFrame:
    """About so many rows, each class in proportion."""
    total = df.count()
    if total <= rows:
        return df
    return first_rows(df, key, (target,), seed, lambda size: half_even(size * (rows / total)))


def prediction_sample(df: DataFrame, key: str, rows: int = 5000, seed: int = 42) -> DataFrame:
    """At most so many rows, with sample_size and population_size."""
    chosen, s = unused(df, "chosen", "size")
    out = first_by_hash(df, seed, key, (), lambda size: F.lit(rows), chosen, s).where(chosen)
    return out.withColumns({"population_size": F.col(s), "sample_size": F.least(s, F.lit(rows).cast("long"))}).drop(chosen, s)


def discard_surplus(trees: DataFrame, target: int, key: str = "tree_id", seed: int = SEED) -> DataFrame:
    """A random `target` of the trees (or workers, or any keys)."""
    return first_rows(trees, key, (), seed, lambda size: F.lit(target))


def usable_size(df: DataFrame, shard: str, target: str, ratio: float, train_share: float = 1 - VALIDATION_SHARE) -> DataFrame:
    """Rows of each shard that training would use: none without a minority, else what validation leaves of both classes, the majority cut."""
    ones, zeros = F.sum((F.col(target) == 1).cast("long")), F.sum((F.col(target) == 0).cast("long"))
    counts = df.groupBy(shard).agg(F.least(ones, zeros).alias("minor"), F.greatest(ones, zeros).alias("major"))
    minor, major = F.floor(F.col("minor") * train_share).cast("long"), F.floor(F.col("major") * train_share).cast("long")
    return counts.select(shard, F.when(F.col("minor") == 0, 0).otherwise(minor + F.least(major, half_even(minor * ratio))).cast("long").alias("usable"))


def quota_split(total: int, parts: int) -> list[int]:
    """total in near-equal whole parts, the first ones larger."""
    return [total // parts + (k < total % parts) for k in range(parts)]


def quotas(workers: DataFrame, total: int, order: str) -> DataFrame:
    """The same as a table: worker and quota."""
    n = F.count("*").over(W.partitionBy(F.lit(0)))  # a row for each worker
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order)) - 1
    return workers.select(order, (F.floor(F.lit(total) / n) + F.when(at < F.lit(total) % n, 1).otherwise(0)).cast("long").alias("quota"))


def tree_quotas(workers: DataFrame, trees: int, worker: str = "worker", size: str = "size", equal: bool = False) -> DataFrame:
    """Trees of each worker in proportion to its rows, by largest remainders.

    An unknown size counts as the mean of the known ones (1 at least), a known
    zero gets none; if no size is known, or all are zero, or `equal` is asked
    for, all count the same.
    """
    whole = W.partitionBy(F.lit(0))  # a row for each worker
    known = F.lit(None).cast("double") if equal else F.col(size).cast("double")
    rows = workers.select(worker, known.alias("s")).withColumn("mean", F.greatest(F.lit(1.0), F.avg("s").over(whole)))
    rows = rows.withColumn("s", F.coalesce("s", "mean", F.lit(1.0)))
    rows = rows.withColumn("s", F.when(F.sum("s").over(whole) == 0, 1.0).otherwise(F.col("s"))).withColumn("exact", F.lit(float(trees)) * F.col("s") / F.sum("s").over(whole))
    rows = rows.withColumn("base", F.floor("exact").cast("long")).withColumn("left", F.lit(trees) - F.sum(F.floor("exact")).over(whole))
    rest = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), worker))
    return rows.select(worker, (F.col("base") + F.when(rest <= F.col("left"), 1).otherwise(0)).cast("long").alias("trees"))


def tree_chunks(trees: int, workers: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of ceil(trees / workers)."""
    step = -(-trees // max(1, workers))
    return [(a, min(trees, a + step)) for a in range(0, trees, step)]


def round_steps(trees: int, workers: int) -> list[tuple[int, int]]:
    """(start, end) of rounds of max(20, 10 * workers) trees."""
    step = max(20, 10 * workers)
    return [(a, min(trees, a + step)) for a in range(0, trees, step)]


def tree_seed(seed: int, tree: int, shard: int | None = None) -> int:
    """A tree's seed: the job's plus its number; in shards also 1000 for each shard before."""
    return seed + tree + (0 if shard is None else 1000 * shard)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


