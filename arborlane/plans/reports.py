"""Analysis of saved run reports: one JSON document a run, scenarios by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import unused

#: Fixed values of the reference: other names of metrics.
ALIASES = {"f1": "f1_score", "roc_auc": "auc", "mean_squared_error": "mse"}


def scan_reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A row for each report file, with its path."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("path", F.input_file_name())


def save_reports(runs: DataFrame, folder: str) -> None:
    """A JSON document a run, each a file; federated runs nest all but name and mode under `results`, as their reports do."""
    rest = [c for c in runs.columns if c not in ("run", "mode")]
    nested = F.to_json(F.struct("run", "mode", F.struct(*rest).alias("results")))
    flat = F.to_json(F.struct(*runs.columns))
    runs.select("run", F.when(F.col("mode") == "federated", nested).otherwise(flat).alias("value")).write.mode("overwrite").partitionBy("run").text(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """path and doc (a variant) of every report below a folder, whatever its shape; what isn't JSON has a null doc."""
    text = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def report_field(name: str, kind: str, doc: str = "doc") -> Column:
    """A field of a report, at its top or under `results`; null where it is missing or of another kind."""
    return F.coalesce(F.try_variant_get(F.col(doc), f"$.{name}", kind), F.try_variant_get(F.col(doc), f"$.results.{name}", kind)).alias(name)


def mode_of(name: Column) -> Column:
    """From a file's name: federated, centralized or unknown."""
    low = F.lower(name)
    return F.when(low.contains("federated"), "federated").when(low.contains("centralized"), "centralized").otherwise("unknown")


def usable(status: Column) -> Column:
    """Neither skipped nor failed."""
    return ~(status.startswith("SKIPPED") | status.startswith("FAILED"))


def metric_name(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), name), name)


def fingerprints(runs: DataFrame) -> DataFrame:
    """run, and its sorted sets of tree counts, test sizes and tasks, as text."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",").alias(c)
    return runs.groupBy("run").agg(text("trees"), text("test_size"), text("task"))


def best_runs(runs: DataFrame, environment_first: bool = True) -> DataFrame:
    """One run for each mode: by environment (cloud first) and coverage, or the other way round, then scenarios, then time."""
    cloud = F.when(F.col("environment") == "cloud", 1).otherwise(0).desc()
    first = [cloud, F.desc("coverage")] if environment_first else [F.desc("coverage"), cloud]
    (n,) = unused(runs, "n")
    w = W.partitionBy("mode").orderBy(*first, F.desc("scenarios"), F.desc("mtime"), "run")
    return runs.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def first_available(metrics: DataFrame, priority: list[str]) -> DataFrame:
    """run, scenario, value: of the first scenario in order that has a value, the one with most workers."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("scenario"))
    rows = metrics.where(F.col("value").isNotNull() & (place > 0))
    return rows.groupBy("run").agg(F.min_by(F.struct("scenario", "workers", "value"), F.struct(place, -F.col("workers"))).alias("m")).select("run", "m.*")


def scaling(series: DataFrame) -> DataFrame:
    """run, workers, seconds, speedup and efficiency against the fewest workers, and the ideal curve, by whole runs."""
    base = W.partitionBy("run").orderBy("workers")
    rows = series.withColumns({"t0": F.first("seconds").over(base), "n0": F.first("workers").over(base)})
    speedup = F.try_divide("t0", "seconds")
    return rows.select("run", "workers", "seconds", speedup.alias("speedup"), (speedup / F.col("workers") * F.col("n0")).alias("efficiency"), (F.col("t0") * F.col("n0") / F.col("workers")).alias("ideal_seconds"))


def ideal_throughput(series: DataFrame, rate: str) -> DataFrame:
    """run, workers, rate and the rate that the fewest workers' would grow to in proportion."""
    base = W.partitionBy("run").orderBy("workers")
    return series.select("run", "workers", rate, (F.first(rate).over(base) * F.col("workers") / F.first("workers").over(base)).alias("ideal"))


def single_node_speedup(series: DataFrame, baseline: DataFrame) -> DataFrame:
    """Against the single node's time of the same load; null if it wasn't measured.  Only training time is compared."""
    return series.join(baseline, "load", "left").select("run", "workers", F.try_divide("single_seconds", "seconds").alias("speedup_single"))


def throughput(rows: DataFrame) -> DataFrame:
    per = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("seconds")), F.lit(0.0))
    return rows.withColumns({"trees_per_s": per("trees"), "samples_per_s": per("samples")})


def time_breakdown(rows: DataFrame, phases: list[str], total: str = "total") -> DataFrame:
    """run, phase, seconds, percent: each phase and what is unaccounted for (never negative)."""
    rest = F.greatest(F.lit(0.0), F.col(total) - sum((F.coalesce(p, F.lit(0.0)) for p in phases), F.lit(0.0)))
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.coalesce(p, F.lit(0.0)).alias("seconds")) for p in phases], F.struct(F.lit("unaccounted").alias("phase"), rest.alias("seconds")))).alias("e")
    return rows.select("run", total, pairs).select("run", "e.phase", "e.seconds", F.coalesce(F.try_divide(F.col("e.seconds") * 100, F.col(total)), F.lit(0.0)).alias("percent"))


def fault_overhead(faulty: DataFrame, clean: DataFrame) -> DataFrame:
    """run, seconds a tree with a fault and without, and the overhead in percent of the clean run of the same run."""
    c = clean.select("run", (F.col("seconds") / F.col("trees")).alias("clean_per_tree"))
    rows = faulty.select("run", "scenario", (F.col("seconds") / F.col("trees")).alias("per_tree")).join(c, "run", "left")
    return rows.withColumn("overhead_percent", F.try_divide(F.col("per_tree") - F.col("clean_per_tree"), "clean_per_tree") * 100)


def environments(runs: DataFrame) -> DataFrame:
    """environment, run, seconds of each environment's best run; seconds are null unless all ran the same load."""
    w = W.partitionBy("environment").orderBy(F.desc("coverage"), F.desc("mtime"), "run")
    best = runs.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    same = best.agg((F.countDistinct("load") == 1).alias("same"))
    return best.join(F.broadcast(same)).select("environment", "run", F.when(F.col("same"), F.col("seconds")).alias("seconds"))  # one row


def network_impact(rows: DataFrame) -> DataFrame:
    """run, clean and degraded seconds of the same run, and the slowdown."""
    sums = rows.groupBy("run").agg(F.max(F.when(F.col("phase") == "clean", F.col("seconds"))).alias("clean"), F.max(F.when(F.col("phase") == "degraded", F.col("seconds"))).alias("degraded"))
    return sums.withColumn("slowdown", F.try_divide("degraded", "clean")).where("clean is not null and degraded is not null")


def metric_deltas(distributed: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric and distributed minus baseline, of the metrics that both have."""
    a = distributed.where("value is not null").select(metric_name(F.col("metric")).alias("metric"), F.col("value").alias("d"))
    b = baseline.where("value is not null").select(metric_name(F.col("metric")).alias("metric"), F.col("value").alias("b"))
    return a.join(b, "metric").select("metric", F.col("d").alias("distributed"), F.col("b").alias("baseline"), (F.col("d") - F.col("b")).alias("delta"))


def latency(probes: DataFrame) -> DataFrame:
    """worker (null: all), probes, least, most, mean and median milliseconds."""
    aggs = [F.count("*").alias("probes"), F.min("ms").alias("least"), F.max("ms").alias("most"), F.avg("ms").alias("mean"), F.median("ms").alias("median")]
    return probes.groupingSets([[F.col("worker")], []], "worker").agg(*aggs)


def density(df: DataFrame, y: str, yhat: str, bins: int = 60) -> DataFrame:
    """y_bin, yhat_bin, n over a common range, cut into square bins."""
    edge = df.agg(F.least(F.min(y), F.min(yhat)).alias("lo"), F.greatest(F.max(y), F.max(yhat)).alias("hi"))
    rows = df.select(F.col(y).alias("__y"), F.col(yhat).alias("__h")).join(F.broadcast(edge))  # one row
    at = lambda c: F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(c) - F.col("lo"), F.col("hi") - F.col("lo")) * bins)).cast("long")
    return rows.groupBy(F.coalesce(at("__y"), F.lit(0)).alias("y_bin"), F.coalesce(at("__h"), F.lit(0)).alias("yhat_bin")).agg(F.count("*").alias("n"))
