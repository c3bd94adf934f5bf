"""Stand-ins: `events` as flows, an event's day as its capture day, its type as its subtype, errors as positives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("subtype"),
        (F.col("event_type") == "error").cast("long").alias("label"),
        "value",
        F.hour("ts").cast("long").alias("hour"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


FLOWS = """flows AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS subtype, CAST(event_type = 'error' AS BIGINT) AS label, value,
  CAST(extract('hour' FROM ts) AS BIGINT) AS hour, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with a worker, a truth y, a score p with ties, and a prediction yhat."""
    return flows(spark, sf_dir).withColumns({"worker": F.col("user_id") % 5, "y": F.col("label"), "p": F.floor("value") / F.lit(500.0)}).withColumn("yhat", (F.col("p") >= 0.1).cast("long"))


SCORED = FLOWS + """, scored AS (SELECT *, user_id % 5 AS worker, label AS y, floor(value) / 500.0::DOUBLE AS p, CAST(floor(value) / 500.0::DOUBLE >= 0.1::DOUBLE AS BIGINT) AS yhat FROM flows)"""


def h(seed: str, key: str) -> str:
    """SQL of functions.hashing.hash32."""
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def rank(seed: str, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {h(seed, key)}, {key})"


def size(by: str = "") -> str:
    return f"count(*) OVER ({f'PARTITION BY {by}' if by else ''})"
