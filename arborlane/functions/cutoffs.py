"""The first so many rows of each group by hash, as a filter in the scan.

`exact_rank` orders all rows; a sample only needs to know where it ends.  Rows
are counted by group and the hash's first 16 bits, the counts say in which of
those buckets the last row lies, and only that bucket's rows (one in 65,536 of
a group) are ordered.  What is left is one hash and key for each group, against
which every row is compared where it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hashing import exact_rank, group_key, hash32, unused

#: Groups whose cut-offs may go to the driver and to all tasks; more groups are ranked by shuffling.
MOST_GROUPS = 100_000


def first_by_hash(df: DataFrame, seed: int | str, key: str, by: tuple[str, ...], wanted: Callable[[Column], Column], name: str, size: str | None = None) -> DataFrame:
    """df with `name`: whether the row is among the first wanted(size) of its `by` group by hash and key; and the group's size, if asked for.

    wanted may use the `by` columns too.  Null groups are groups of their own,
    a null key comes first.  Keys are unique within a group: rows that share
    one are chosen together.  An empty table stays empty.
    """
    spark = df.sparkSession
    h, g, part, n, total, before, most, at, last, local = unused(df, "h", "g", "part", "n", "total", "before", "most", "at", "last", "local")
    hashed = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys((key, *by))]).withColumn(h, hash32(seed, F.col(f"`{key}`"))).withColumn(g, group_key(by)).withColumn(part, F.shiftright(h, 16))
    group = W.partitionBy(g)  # at most 65,536 counts
    counts = hashed.groupBy(*[F.col(f"`{c}`") for c in by], g, part).agg(F.count("*").alias(n))
    counts = counts.withColumn(total, F.sum(n).over(group)).withColumn(before, F.sum(n).over(group.orderBy(part)) - F.col(n))
    counts = counts.withColumn(most, F.least(F.greatest(wanted(F.col(total)), F.lit(0)), F.col(total)).cast("long"))
    ends = counts.where((F.col(before) < F.col(most)) & (F.col(most) <= F.col(before) + F.col(n)) | (F.col(most) == 0) & (F.col(before) == 0))
    ends = ends.select(g, part, (F.col(most) - F.col(before)).alias(at), total).limit(MOST_GROUPS + 1).collect()  # a row for each group
    if len(ends) > MOST_GROUPS:
        out = exact_rank(df, seed, key, by, local, total).withColumn(name, F.col(local) <= wanted(F.col(total)))
        return out.withColumnRenamed(total, size).drop(local) if size else out.drop(local, total)
    few = F.broadcast(spark.createDataFrame([(r[g], r[part], r[at]) for r in ends], f"`{g}` string, `{part}` long, `{at}` long"))
    inside = hashed.join(few, [g, part]).withColumn(local, F.row_number().over(W.partitionBy(g).orderBy(h, F.col(f"`{key}`"))))
    cuts = {r[g]: (r[h], r[last]) for r in inside.where(F.col(local) == F.col(at)).select(g, h, F.col(f"`{key}`").alias(last)).collect()}
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}[key]
    rows = [(r[g], *cuts.get(r[g], (-1, None)), r[total]) for r in ends]
    own, until = F.col(f"`{key}`"), F.col(last)
    if not by:
        _, end, value, size_of = rows[0] if rows else ("", -1, None, 0)
        chosen = (hash32(seed, own) < end) | ((hash32(seed, own) == end) & F.coalesce(own <= F.lit(value).cast(kind), own.isNull()))
        return df.withColumns({name: chosen} | ({size: F.lit(size_of).cast("long")} if size else {}))
    few = F.broadcast(spark.createDataFrame(rows, f"`{g}` string, `{at}` long, `{last}` {kind}, `{total}` long"))
    chosen = (F.col(h) < F.col(at)) | ((F.col(h) == F.col(at)) & F.coalesce(own <= until, own.isNull()))
    out = df.withColumn(h, hash32(seed, own)).withColumn(g, group_key(by)).join(few, g).withColumn(name, chosen)
    return (out.withColumnRenamed(total, size) if size else out.drop(total)).drop(h, g, at, last)
