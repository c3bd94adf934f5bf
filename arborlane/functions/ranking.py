"""Running sums over a whole table in the order of a column, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import group_key, unused

#: Ranges of values that are summed apart.
RANGES = 64


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with columns name: the sum of `column` over the rows up to each row's `order` value, ties included, within the `by` columns.

    Values fall into ranges between approximate quantiles; each range is a
    window of its own, and the totals of the ranges before (at most `ranges`
    rows for each group) are added.
    """
    bounds = sorted(set(df.stat.approxQuantile(order, [k / ranges for k in range(1, ranges)], 0.005))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    at, g = unused(df, "__p", "__g")
    dealt = df.withColumn(at, part.cast("int")).withColumn(g, group_key(by))
    direction = F.desc if descending else F.asc
    names = list(sums)
    of, to, up = (unused(df, *[f"__{k}{i}" for i in range(len(names))]) for k in "tbl")
    totals = dealt.groupBy(g, at).agg(*[F.sum(c).alias(of[i]) for i, c in enumerate(sums.values())])
    before = W.partitionBy(g).orderBy(direction(at)).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(g, at, *[F.coalesce(F.sum(of[i]).over(before), F.lit(0)).alias(to[i]) for i in range(len(names))])
    # Sums in ranges first, then the join: both need the rows by group and range, so they shuffle once.
    local = W.partitionBy(g, at).orderBy(direction(order)).rangeBetween(W.unboundedPreceding, 0)
    for i, column in enumerate(sums.values()):
        dealt = dealt.withColumn(up[i], F.sum(column).over(local))
    out = dealt.join(totals, [g, at])
    for i, name in enumerate(names):
        out = out.withColumn(name, F.col(to[i]) + F.col(up[i]))
    return out.drop(at, g, *to, *up)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row for each distinct value of the column: the value, its rows (__n) and the mean of their ranks from 1."""
    counts = df.groupBy(F.col(column).cast("double").alias(column)).agg(F.count("*").alias("__n"))
    return running_sums(counts, column, {"__upto": "__n"}).withColumn(name, F.col("__upto") - (F.col("__n") - 1) / 2).drop("__upto")
