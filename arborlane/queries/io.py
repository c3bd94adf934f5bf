"""Registered queries that write with a sink and read back with a source, each with the same in SQL over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, forest, voting
from ..plans import federated
from ..session import shared_folder
from ..sources import files
from .base import FLOWS, flows, h, rank, size
from .forests import FEATURES, SCORE_SQL, nodes


def scratch(spark: SparkSession) -> str:
    """A folder of its own for each call."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return flows(spark, sf).select("event_id", "day", "subtype", "label", "value")


def _by_subtype(spark: SparkSession, sf: str) -> tuple[str, list[str]]:
    """A CSV source for each subtype (a handful), and their folder."""
    folder = scratch(spark)
    names = sorted(r[0] for r in _events(spark, sf).select("subtype").distinct().collect())
    for name in names:
        files.write_csv(_events(spark, sf).where(F.col("subtype") == name), f"{folder}/{name}.csv")
    return folder, [f"{folder}/{name}.csv" for name in names]


def _typed(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(F.col("event_id").cast("long").alias("event_id"), F.col(label).cast("long").alias("label"), F.col("value").cast("double").alias("value"))


def csv_round_trip(spark, sf):
    path = f"{scratch(spark)}/events.csv"
    files.write_csv(_events(spark, sf), path)
    return _typed(files.scan_csv(spark, path))


def csv_many_sources(spark, sf):
    return _typed(files.scan_csv(spark, "|".join(_by_subtype(spark, sf)[1])))


def discovered_sources(spark, sf):
    folder, _ = _by_subtype(spark, sf)
    return spark.createDataFrame([(p.rsplit("/", 1)[1],) for p in files.discover(spark, folder)], "name string")


def source_row_counts(spark, sf):
    name = F.element_at(F.split("source", "/"), -2)  # a source is a folder of part files here
    return files.count_rows(spark, _by_subtype(spark, sf)[1]).groupBy(name.alias("name")).agg(F.sum("n").alias("n"))


def cached_row_counts(spark, sf):
    folder, sources = _by_subtype(spark, sf)
    files.cached_counts(spark, sources[:2], f"{folder}/counts")
    found = files.cached_counts(spark, sources, f"{folder}/counts")
    return spark.createDataFrame([(p.rsplit("/", 1)[1], n) for p, n in found.items()], "name string, n long")


def parquet_row_count(spark, sf):
    return spark.createDataFrame([(files.count_parquet(spark, f"{sf}/events.parquet"),)], "n long")


def mirrored_sources(spark, sf):
    folder, sources = _by_subtype(spark, sf)
    files.mirrored(spark, sources, f"{folder}/mirror")
    return _typed(files.mirrored(spark, sources, f"{folder}/mirror"), "Label")


def source_probe(spark, sf):
    _, sources = _by_subtype(spark, sf)
    rows = [(p.rsplit("/", 1)[1], files.exists(spark, p), files.content_length(spark, p) > 0, files.exists(spark, f"{p}.gone")) for p in sources]
    return spark.createDataFrame(rows, "name string, found boolean, has_bytes boolean, gone boolean")


def pruned_scan(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id").where("user_id % 3 = 0")


CHUNK = 500


def chunk_sample(spark, sf):
    path = f"{scratch(spark)}/events.csv"
    files.write_csv(_events(spark, sf).orderBy("event_id").coalesce(1), path)
    rows = files.numbered_csv(spark, path).withColumn("source", F.lit("events"))
    return files.chunk_sample(rows, "source", "row", 0.1, chunk=CHUNK).select(F.col("event_id").cast("long").alias("event_id"), "row")


def json_document(spark, sf):
    path = f"{scratch(spark)}/metrics"
    files.write_json(spark, path, {r["subtype"]: r["count"] for r in _events(spark, sf).groupBy("subtype").count().collect()})
    return spark.createDataFrame(list(files.read_json(spark, path).items()), "subtype string, n long")


def shard_sink(spark, sf):
    path = scratch(spark)
    rows = flows(spark, sf).select("event_id", (F.col("user_id") % 4).alias("shard_id"), F.when(F.col("label") == 1, "test").otherwise("train").alias("split"))
    files.write_shards(rows, path)
    return spark.read.parquet(path).select("event_id", F.col("shard_id").cast("long").alias("shard_id"), "split")


def provisioned_shards(spark, sf):
    path = scratch(spark)
    rows = flows(spark, sf).select("event_id", "day", F.col("label").alias("Label"))
    federated.provision(rows, path, "event_id", 3, "by_day", "day")
    manifest = federated.provision(rows, path, "event_id", 99)  # there already: left as it is
    return spark.read.parquet(f"{path}/shards").select("event_id", F.col("shard_id").cast("long").alias("shard_id"), "split", F.lit(manifest["num_workers"]).cast("long").alias("workers"))


def delta_parts(spark, sf):
    path = scratch(spark)
    rows = flows(spark, sf)
    for part in (0, 1, 2, 3):
        files.append_part(rows.where(F.col("user_id") % 4 == part).select("event_id"), path, part)
    files.append_part(rows.where("user_id % 4 = 1 and label = 1").select("event_id"), path, 1)  # written again: replaced
    files.purge_parts(spark, path, 2)
    return spark.read.parquet(path).select("event_id", F.col("part").cast("long").alias("part"))


def feature_projection(spark, sf):
    df = flows(spark, sf).withColumnRenamed("label", "Label")
    clean.require_columns(df, ("value", "hour"))
    return clean.drop_selected(clean.project(df, ["value", "hour", "k"]), ["hour", "absent"])


def federated_prepare(spark, sf):
    shard = F.col("user_id") % 6
    df = flows(spark, sf).select("event_id", shard.alias("shard_id"), F.when(shard == 5, 0).otherwise(F.col("label")).cast("long").alias("label"))
    return federated.prepare_shards(df, "event_id", "shard_id", "label", 1.5).select("event_id", "shard_id", "part")


THRESHOLDS = {0: 0.3, 1: 0.42, 2: 0.55, 3: None}


def federated_infer(spark, sf):
    df = flows(spark, sf).withColumn("shard_id", F.col("user_id") % 5)
    voted = voting.from_sums(forest.vote_sums(df, nodes(spark), FEATURES, "event_id", 2, voting.SUPPORT_CAP), "event_id", [0, 1])
    rows = voted.select("event_id", F.element_at("probs", 2).alias("p"), F.col("yhat").cast("long").alias("yhat")).join(df.select("event_id", "shard_id"), "event_id")
    found = spark.createDataFrame(list(THRESHOLDS.items()), "shard_id long, threshold double")
    return federated.by_shard(rows, found, "shard_id").select("event_id", "shard_id", "yhat")


_NAMES = f"WITH {FLOWS}, names AS (SELECT subtype || '.csv' AS name, count(*) AS n FROM flows GROUP BY 1)"
_TYPED = f"WITH {FLOWS} SELECT event_id, label, value FROM flows"
_AT = " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in THRESHOLDS.items() if v is not None)
QUERIES = {
    "csv_round_trip": (csv_round_trip, _TYPED),
    "csv_many_sources": (csv_many_sources, _TYPED),
    "discovered_sources": (discovered_sources, f"{_NAMES} SELECT name FROM names"),
    "source_row_counts": (source_row_counts, f"{_NAMES} SELECT name, n FROM names"),
    "cached_row_counts": (cached_row_counts, f"{_NAMES} SELECT name, n FROM names"),
    "parquet_row_count": (parquet_row_count, "SELECT count(*) AS n FROM events"),
    "mirrored_sources": (mirrored_sources, _TYPED),
    "source_probe": (source_probe, f"{_NAMES} SELECT name, n > 0 AS found, n > 0 AS has_bytes, n < 0 AS gone FROM names"),
    "pruned_scan": (pruned_scan, "SELECT event_id, user_id FROM events WHERE user_id % 3 = 0"),
    "chunk_sample": (
        chunk_sample,
        f"""WITH numbered AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS "row" FROM events), c AS (SELECT *, "row" // {CHUNK} AS chunk FROM numbered)
  SELECT event_id, "row" FROM c QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY ('0x' || substr(md5(chunk || ':events:' || "row"), 1, 8))::BIGINT, "row") <= round_even({size('chunk')} * 0.1::DOUBLE, 0)""",
    ),
    "json_document": (json_document, f"WITH {FLOWS} SELECT subtype, count(*) AS n FROM flows GROUP BY 1"),
    "shard_sink": (shard_sink, f"WITH {FLOWS} SELECT event_id, user_id % 4 AS shard_id, CASE WHEN label = 1 THEN 'test' ELSE 'train' END AS split FROM flows"),
    "provisioned_shards": (
        provisioned_shards,
        f"""WITH {FLOWS}, s AS (SELECT *, CAST((dense_rank() OVER (ORDER BY day) - 1) % 3 AS BIGINT) AS shard_id FROM flows)
  SELECT event_id, shard_id, CASE WHEN {size('shard_id, label')} > 1 AND {rank('123', 'event_id', 'shard_id, label')} <= round_even({size('shard_id, label')} * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split, 3::BIGINT AS workers FROM s""",
    ),
    "delta_parts": (delta_parts, f"WITH {FLOWS} SELECT event_id, user_id % 4 AS part FROM flows WHERE user_id % 4 = 0 OR (user_id % 4 = 1 AND label = 1)"),
    "feature_projection": (feature_projection, f'WITH {FLOWS} SELECT value, k, label AS "Label" FROM flows'),
    "federated_prepare": (
        federated_prepare,
        f"""WITH {FLOWS}, s AS (SELECT event_id, user_id % 6 AS shard_id, CASE WHEN user_id % 6 = 5 THEN 0 ELSE label END AS label FROM flows),
  c AS (SELECT *, least(count(*) FILTER (WHERE label = 1) OVER w, count(*) FILTER (WHERE label = 0) OVER w) AS minor, {rank('123-val', 'event_id', 'shard_id, label')} AS v, {size('shard_id, label')} AS n FROM s WINDOW w AS (PARTITION BY shard_id)),
  p AS (SELECT *, CASE WHEN minor >= 2 AND n > 1 AND v <= round_even(n * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS part FROM c),
  t AS (SELECT *, count(*) FILTER (WHERE part = 'train' AND label = 1) OVER w AS a, count(*) FILTER (WHERE part = 'train' AND label = 0) OVER w AS b, row_number() OVER (PARTITION BY shard_id, label, part ORDER BY {h('123', 'event_id')}, event_id) AS r FROM p WINDOW w AS (PARTITION BY shard_id))
  SELECT event_id, shard_id, part FROM t WHERE part = 'validation' OR minor = 0 OR least(a, b) = 0 OR label <> CASE WHEN a > b THEN 1 ELSE 0 END OR r <= round_even(least(a, b) * 1.5::DOUBLE, 0)""",
    ),
    "federated_infer": (
        federated_infer,
        f"""WITH RECURSIVE {SCORE_SQL}, w AS (SELECT event_id, sum(p * least(support, 50)) / CASE WHEN sum(least(support, 50)) = 0 THEN 1 ELSE sum(least(support, 50)) END AS q FROM votes GROUP BY event_id)
  SELECT event_id, user_id % 5 AS shard_id, CAST(CASE WHEN user_id % 5 IN (3, 4) THEN q > 0.5 ELSE q >= CASE user_id % 5 {_AT} END END AS BIGINT) AS yhat FROM w JOIN flows USING (event_id)""",
    ),
}
