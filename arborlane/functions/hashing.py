"""Draws that hang on keys and not on how rows are dealt.

Every sample, split, shard and bootstrap draw orders rows by a hash of a seed
and the row's key, so any partitioning, and a retried task, gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash buckets within which rows are ranked.
BUCKETS = 1024


def hash32(seed: int | str | Column, *keys: Column | str) -> Column:
    """The first 32 bits of the MD5 of seed and keys, colon-joined, as a long."""
    parts = [seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int | str | Column, *keys: Column | str) -> Column:
    """A double in [0, 1)."""
    return hash32(seed, *keys) / F.lit(float(1 << 32))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def exact_rank(df: DataFrame, seed: int | str, key: str, by: tuple[str, ...] = (), rank: str = "rank", size: str = "size", buckets: int = BUCKETS) -> DataFrame:
    """df with each row's rank (from 1) by hash and key among the rows with the same `by` columns, and their number.

    No window holds more than one hash bucket of a group, so a group of any
    size is ranked by many tasks: ranks within buckets plus the sizes of the
    buckets before.  Null groups are groups of their own.
    """
    h, b, g, n, local, before, total = unused(df, "__h", "__b", "__g", "__n", "__local", "__before", "__size")
    bucket = F.shiftright(h, 22) if buckets == 1024 else F.floor(F.col(h) / F.lit((1 << 32) / buckets))
    hashed = df.withColumn(h, hash32(seed, F.col(f"`{key}`"))).withColumn(b, bucket).withColumn(g, group_key(by))
    counts = hashed.groupBy(g, b).agg(F.count("*").alias(n))
    group = W.partitionBy(g)  # at most `buckets` rows for each group
    counts = counts.select(g, b, (F.sum(n).over(group.orderBy(b)) - F.col(n)).alias(before), F.sum(n).over(group).alias(total))
    # Ranks first, then the join: both need the rows by group and bucket, so they shuffle once.
    ranked = hashed.withColumn(local, F.row_number().over(W.partitionBy(g, b).orderBy(h, F.col(f"`{key}`"))))
    out = ranked.join(counts, [g, b]).withColumn(rank, F.col(before) + F.col(local)).withColumn(size, F.col(total))
    return out.drop(h, b, g, local, before, total)


def group_key(by: tuple[str, ...]) -> Column:
    """The values of the columns as one string that is never null; a null value is unlike any other."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])) if by else F.lit("")
