"""Operator 9, sharding: a permutation-filled lookup table places each key in constant time.

Every shard prefers the slots of a table of prime size M in an order of its
own, offset + i * skip modulo M.  The shards take turns, each claiming the
first free slot in its order, until the table is full; so shares differ by one
slot at most, and adding or removing a shard moves few slots beyond those that
it must.  A key's place is table[hash(key) mod M].

The table has M rows whatever the input, so broadcasting it is bounded; keys
never shuffle.  Hot keys: a key's rows are placed where they are, in the scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Slots of the table (prime) and shards of the registered query.
TABLE_SIZE, SHARDS = 65537, 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Which shard (its index) each slot belongs to.

    Raises ValueError for a size that is not prime, for no shard or repeated
    shards, and for more shards than slots.
    """
    if not is_prime(size):
        raise ValueError("the table's size must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one and no more than slots")
    place, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % size
            table[place[k]] = k
            free -= 1
            if not free:
                break
    return table


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, slot and shard (a name of `shards`) of every row.

    A null key hashes like an empty string, repeated keys share a place, an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, size))], "slot long, shard string")
    keys = docs.select(F.col(f"`{key_col}`").alias("doc_id"))
    keys = keys.withColumn("slot", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(size)))
    return keys.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents"), [f"shard-{k:03d}" for k in range(SHARDS)])
