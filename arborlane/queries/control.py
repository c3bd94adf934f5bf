"""Job control over logs made of events, and report analytics over reports saved from orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import reports
from ..session import scratch
from ..streaming import state
from .base import FLOWS, flows


def _events(spark, sf, *columns: str):
    """Rows of a log, an event each, in the order of their numbers."""
    return flows(spark, sf).selectExpr(*columns)


def _now(spark, sf) -> float:
    return float(flows(spark, sf).count())


#: Logs made of events, as expressions that Spark and DuckDB read alike.
BEATS = ["concat('w', user_id % 40) AS worker_name", "CAST(event_id AS DOUBLE) AS at_s"]
TASKS = ["concat('t', event_id % 4000) AS task_id", "concat('j', user_id % 7) AS job_id", "CASE WHEN k % 5 > 0 THEN concat('w', k % 5) END AS worker_name", "CASE k % 4 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' ELSE 'REQUEUED' END AS status", "CAST(event_id AS DOUBLE) AS at_s"]
JOBS = ["concat('j', user_id % 200) AS job_id", "CASE k % 4 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'FAILED' ELSE 'QUEUED' END AS status", "CAST(event_id AS DOUBLE) AS at_s"]
LOCKS = ["concat('j', user_id % 200) AS lock_key", "concat('o', k % 3) AS owner", "CASE k % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'refresh' ELSE 'acquire' END AS action", "CAST(hour * 100 AS DOUBLE) AS ttl", "CAST(event_id AS DOUBLE) AS at_s"]
MESSAGES = ["concat('m', event_id % 500) AS message_id", "CAST(event_id AS DOUBLE) AS sent_at"]
RECEIPTS = ["concat('m', user_id * 7 % 500) AS message_id", "CASE WHEN k % 9 = 0 THEN 'delete' WHEN k % 2 = 0 THEN 'extend' ELSE 'receive' END AS action", "CAST(event_id AS DOUBLE) AS at_s"]


def _log(name: str, columns: list[str]) -> str:
    return f"{name} AS (SELECT {', '.join(columns)} FROM flows)"


def _beats(spark, sf):
    return _events(spark, sf, *BEATS)


def _tasks(spark, sf):
    return _events(spark, sf, *TASKS)


def _jobs(spark, sf):
    return _events(spark, sf, *JOBS)


def _locks(spark, sf):
    return _events(spark, sf, *LOCKS)


_JOBS_ONLY = _log("jobs", JOBS)
_NOW = "(SELECT count(*)::DOUBLE FROM flows)"
_TASKS, _JOBS, _BEATS, _LOCKS = (f"{FLOWS}, {_log(n, c)}" for n, c in (("tasks", TASKS), ("jobs", JOBS), ("beats", BEATS), ("locks", LOCKS)))
_HISTORY = f"""{_LOCKS}, turns AS (SELECT *, row_number() OVER (PARTITION BY lock_key ORDER BY at_s, owner) AS n FROM locks),
  fold AS (SELECT lock_key, 0 AS n, NULL::DOUBLE AS at_s, NULL::VARCHAR AS owner, NULL::VARCHAR AS action, FALSE AS granted, NULL::VARCHAR AS holder, 0.0::DOUBLE AS expires_at FROM (SELECT DISTINCT lock_key FROM locks)
  UNION ALL SELECT lock_key, n, at_s, owner, action, ok, CASE WHEN ok AND action = 'release' THEN NULL WHEN ok THEN owner ELSE old END, CASE WHEN ok AND action = 'release' THEN 0.0::DOUBLE WHEN ok THEN at_s + ttl ELSE until END FROM
  (SELECT t.lock_key, t.n, t.at_s, t.owner, t.action, t.ttl, f.holder AS old, f.expires_at AS until,
   CASE WHEN t.action = 'acquire' THEN f.holder IS NULL OR t.at_s >= f.expires_at OR f.holder = t.owner ELSE f.holder IS NOT DISTINCT FROM t.owner AND f.holder IS NOT NULL AND t.at_s < f.expires_at END AS ok
   FROM fold f JOIN turns t ON t.lock_key = f.lock_key AND t.n = f.n + 1))"""
_OWNERS = f"owners AS (SELECT lock_key, CASE WHEN expires_at > {_NOW} THEN holder END AS owner FROM fold QUALIFY row_number() OVER (PARTITION BY lock_key ORDER BY n DESC) = 1)"


def live_workers(spark, sf):
    return state.live_workers(_beats(spark, sf), _now(spark, sf)).withColumn("live", F.col("live").cast("long"))


def task_status(spark, sf):
    return state.latest(_tasks(spark, sf), "task_id").select("task_id", "job_id", "worker_name", "status", "at_s")


def task_counts(spark, sf):
    return state.status_counts(_tasks(spark, sf))


def round_barrier(spark, sf):
    return state.all_done(_tasks(spark, sf), 4).withColumn("passed", F.col("passed").cast("long"))


def task_retries(spark, sf):
    return state.retries(_tasks(spark, sf)).withColumn("retry", F.col("retry").cast("long"))


def tasks_of_worker(spark, sf):
    return state.lookup(_tasks(spark, sf), job_id="j1", worker_name="w3").select("task_id", "status")


def resume_missing(spark, sf):
    done = _tasks(spark, sf).where("status = 'COMPLETED'")
    return state.missing(_tasks(spark, sf).select("task_id").distinct(), done, "task_id")


def put_if_absent(spark, sf):
    rows = _events(spark, sf, "concat('j', user_id * 2) AS job_id", "'QUEUED' AS status", "CAST(99 AS DOUBLE) AS at_s").distinct()
    return state.put_if_absent(_jobs(spark, sf), rows, "job_id").select("job_id", "status", "at_s")


def job_latest(spark, sf):
    return state.latest(_jobs(spark, sf), "job_id").select("job_id", "status", "at_s")


def job_state(spark, sf):
    return state.job_states(_jobs(spark, sf)).select("job_id", "status", F.col("ignored").cast("long").alias("ignored"))


def lock_history(spark, sf):
    return state.lock_history(_locks(spark, sf)).withColumn("granted", F.col("granted").cast("long"))


def lock_owner(spark, sf):
    return state.lock_owners(_locks(spark, sf), _now(spark, sf))


def orphan_jobs(spark, sf):
    return state.orphans(_jobs(spark, sf), _locks(spark, sf), _now(spark, sf)).select("job_id")


def queue_state(spark, sf):
    return state.queue_state(_events(spark, sf, *MESSAGES).groupBy("message_id").agg(F.min("sent_at").alias("sent_at")), _events(spark, sf, *RECEIPTS), _now(spark, sf))


def daily_alarm_rate(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", (F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") >= 50).cast("int").alias("yhat"))
    out = state.alarm_rates(events, "ts", "y", "yhat")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "fp", F.round("rate", 6).alias("rate"))


def _run_rows(spark, sf):
    """Runs made of orders by customer number; all of it counts, least and largest values."""
    orders, r = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_custkey") % 37
    runs = orders.groupBy(r.alias("r")).agg((F.count("*") % 5).alias("coverage"), F.count_distinct("o_orderpriority").alias("scenarios"), F.max("o_orderkey").cast("double").alias("mtime"), F.floor(F.max("o_totalprice")).cast("double").alias("seconds"))
    r = F.col("r")
    return runs.select(
        F.concat(F.lit("r"), r).alias("run"), F.when(r % 3 == 0, "federated").when(r % 3 == 1, "centralized").otherwise("unknown").alias("mode"), F.when(r % 2 == 0, "cloud").otherwise("local").alias("environment"), "coverage", "scenarios", "mtime",
        F.when(r % 4 == 0, 50).otherwise(100).cast("long").alias("trees"), ((r % 3 + 1) * 1000).cast("long").alias("test_size"), F.when(r % 5 == 0, "regressor").otherwise("classifier").alias("task"), "seconds",
    )


_KINDS = {"run": "string", "mode": "string", "environment": "string", "coverage": "long", "scenarios": "long", "mtime": "double", "trees": "long", "test_size": "long", "task": "string", "seconds": "double"}
_RUNS = """runs AS (SELECT 'r' || r AS run, CASE r % 3 WHEN 0 THEN 'federated' WHEN 1 THEN 'centralized' ELSE 'unknown' END AS mode, CASE r % 2 WHEN 0 THEN 'cloud' ELSE 'local' END AS environment, coverage, scenarios, mtime,
  CASE r % 4 WHEN 0 THEN 50 ELSE 100 END::BIGINT AS trees, ((r % 3 + 1) * 1000)::BIGINT AS test_size, CASE r % 5 WHEN 0 THEN 'regressor' ELSE 'classifier' END AS task, seconds
  FROM (SELECT o_custkey % 37 AS r, count(*) % 5 AS coverage, count(DISTINCT o_orderpriority) AS scenarios, max(o_orderkey)::DOUBLE AS mtime, floor(max(o_totalprice)) AS seconds FROM orders GROUP BY 1))"""


def _saved(spark, sf, runs, kinds: dict[str, str]):
    """The same runs, saved as reports of two shapes and read back from the files."""
    folder = scratch(spark, "reports")
    reports.save_reports(runs, folder)
    return reports.read_reports(spark, folder).select(*[reports.report_field(c, k) for c, k in kinds.items()])


def _runs(spark, sf):
    return _saved(spark, sf, _run_rows(spark, sf), _KINDS)


def _series(spark, sf):
    """Times of 50 runs by workers, read from a report for each run and size."""
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    rows = orders.groupBy((F.col("o_custkey") % 50).alias("r"), (F.year("o_orderdate") - 1990).cast("long").alias("workers")).agg(F.floor(F.max("o_totalprice")).cast("double").alias("seconds"), F.count("*").alias("trees"))
    rows = rows.select(F.concat(F.lit("r"), "r", F.lit("-"), "workers").alias("run"), F.concat(F.lit("r"), "r").alias("name"), F.when(F.col("r") % 2 == 0, "federated").otherwise("centralized").alias("mode"), "workers", "seconds", "trees")
    return _saved(spark, sf, rows, {"name": "string", "workers": "long", "seconds": "double", "trees": "long"}).withColumnRenamed("name", "run")


_SERIES = "series AS (SELECT 'r' || (o_custkey % 50) AS run, (year(o_orderdate) - 1990)::BIGINT AS workers, floor(max(o_totalprice)) AS seconds, count(*) AS trees FROM orders GROUP BY ALL)"


def _by_status(spark, sf, n: int, names: dict[str, str], name: str):
    """Runs of n groups of customers, each by the status of its orders."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_orderstatus").isin(*names))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("o_orderstatus"))
    return orders.groupBy(F.concat(F.lit("r"), F.col("o_custkey") % n).alias("run"), kind.alias(name)).agg(F.floor(F.max("o_totalprice")).cast("double").alias("seconds"), F.count("*").alias("trees"))


def _status_sql(n: int, names: dict[str, str], name: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"SELECT 'r' || (o_custkey % {n}) AS run, CASE o_orderstatus {cases} END AS {name}, floor(max(o_totalprice)) AS seconds, count(*) AS trees FROM orders WHERE o_orderstatus IN ({', '.join(repr(k) for k in names)}) GROUP BY ALL"


SCENARIOS, PHASE = {"F": "crash", "O": "clean", "P": "failover"}, {"O": "clean", "F": "degraded"}


def run_fingerprint(spark, sf):
    return reports.fingerprints(_runs(spark, sf).withColumn("run", F.col("mode")))


def best_run(spark, sf):
    return reports.best_runs(_runs(spark, sf)).select("mode", "run")


def best_run_coverage(spark, sf):
    return reports.best_runs(_runs(spark, sf), False).select("mode", "run")


def run_mode(spark, sf):
    c = F.col("o_custkey")
    names = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.when(c % 3 == 0, "Test_Federated_").when(c % 3 == 1, "centralized-").otherwise("x"), c % 100, F.lit(".json")).alias("name")).distinct()
    return names.select("name", reports.mode_of(F.col("name")).alias("mode"))


def usable_runs(spark, sf):
    status = F.when(F.col("o_orderkey") % 4 == 0, "PARTIAL").when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "SKIPPED_NO_PERMISSION").otherwise("SUCCESS")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("scenario"), status.alias("status")).distinct()
    return rows.where(reports.usable(F.col("status")))


def first_metrics(spark, sf):
    scenario = F.when(F.col("o_orderpriority") == "1-URGENT", "performance").when(F.col("o_orderpriority") == "2-HIGH", "scaling").otherwise("network")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("r"), F.col("o_custkey") % 50).alias("run"), scenario.alias("scenario"), F.col("o_orderkey").alias("workers"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("value"))
    return reports.first_available(rows, ["performance", "scaling"])


def scaling_speedup(spark, sf):
    out = reports.scaling(_series(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("speedup", "efficiency", "ideal_seconds")})


def single_node_speedup(spark, sf):
    series = _series(spark, sf).withColumnRenamed("trees", "load")
    single = series.groupBy("load").agg((F.max("seconds") * 4).alias("single_seconds"), F.count("*").alias("n")).where("n > 1").drop("n")  # other loads weren't measured
    return reports.single_node_speedup(series, single)


def ideal_throughput(spark, sf):
    rows = _series(spark, sf).withColumn("rate", F.col("trees") / F.col("seconds"))
    out = reports.ideal_throughput(rows, "rate")
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "ideal")})


def throughput(spark, sf):
    items, r = spark.read.parquet(f"{sf}/lineitem.parquet"), F.col("l_suppkey") % 20
    rows = items.groupBy(F.concat(F.lit("s"), r).alias("run")).agg(F.count("*").alias("trees"), F.sum("l_quantity").cast("long").alias("samples"), F.max(F.when(r % 7 > 0, F.col("l_linenumber")).otherwise(0)).cast("double").alias("seconds"))
    return reports.throughput(rows)


def _phases(spark, sf):
    """Phases of runs made of line items by supplier, read from saved reports; some lack a phase."""
    r = F.col("r")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_suppkey") % 40).alias("r")).agg(F.min("l_quantity").alias("load"), F.max("l_quantity").alias("grow"), F.max("l_linenumber").alias("lines"))
    rows = rows.select(F.concat(F.lit("s"), "r").alias("run"), F.when(r % 2 == 0, "federated").otherwise("centralized").alias("mode"), F.when(r % 6 == 0, 0.0).otherwise(F.col("grow") * 1.5).alias("total"), "load", "grow", F.when(r % 5 > 0, F.col("lines").cast("double")).alias("save"))
    return _saved(spark, sf, rows, {"run": "string", "total": "double", "load": "double", "grow": "double", "save": "double"})


def time_breakdown(spark, sf):
    out = reports.time_breakdown(_phases(spark, sf), ["load", "grow", "save"])
    return out.withColumn("percent", F.round("percent", 6))


def fault_overhead(spark, sf):
    rows = _by_status(spark, sf, 30, SCENARIOS, "scenario")
    out = reports.fault_overhead(rows.where("scenario <> 'clean'"), rows.where("scenario = 'clean'"))
    return out.withColumns({c: F.round(c, 6) for c in ("per_tree", "clean_per_tree", "overhead_percent")})


def environment_comparison(spark, sf):
    return reports.environments(_runs(spark, sf).withColumn("load", F.col("trees")))


def network_impact(spark, sf):
    return reports.network_impact(_by_status(spark, sf, 60, PHASE, "phase"))


def metric_deltas(spark, sf):
    """Of two reports that name their metrics differently, one without an AUC."""
    df = flows(spark, sf)

    def report(run: str, mode: str, rows, names: list[str]):
        values = [F.max("value"), F.count_if(F.col("label") == 1) / F.count("*"), F.lit(None).cast("double") if mode == "federated" else F.min("value"), F.max("hour").cast("double")]
        return rows.agg(*[v.alias(n) for v, n in zip(values, names, strict=True)]).select(F.lit(run).alias("run"), F.lit(mode).alias("mode"), *names)

    def table(rows, names: list[str]):
        wide = _saved(spark, sf, rows, {n: "double" for n in names})
        return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("m.*")

    first, second = ["f1", "accuracy", "roc_auc", "mse"], ["f1_score", "accuracy", "auc", "mean_squared_error"]
    a = table(report("a", "federated", df.where("user_id % 2 = 0"), first), first)
    b = table(report("b", "centralized", df.where("user_id % 2 = 1"), second), second)
    out = reports.metric_deltas(a, b)
    return out.withColumns({c: F.round(c, 6) for c in ("distributed", "baseline", "delta")})


def latency_stats(spark, sf):
    out = reports.latency(flows(spark, sf).select(F.concat(F.lit("w"), F.col("user_id") % 9).alias("worker"), F.col("value").alias("ms")))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median")})


def row_count_summary(spark, sf):
    from ..sources.files import row_summary

    return row_summary(flows(spark, sf).groupBy(F.col("subtype").alias("source")).agg(F.count("*").alias("n")))


def importance_watchlist(spark, sf):
    from ..operators.selection import cut, watchlist

    rows = flows(spark, sf).groupBy(F.concat(F.lit("u"), "k").alias("feature")).agg((F.max("value") - 300).alias("importance"))
    return watchlist(cut(rows), [f"u{k}" for k in range(0, 100, 3)]).withColumns({"importance": F.round("importance", 6)}).withColumn("watched", F.col("watched").cast("long"))


def ward_clusters(spark, sf):
    from ..operators.selection import matrix, spearman
    from ..operators.selection import ward_clusters as clusters

    names = ["value", "near", "hour", "k", "far"]
    df = flows(spark, sf).withColumns({"near": F.col("value") * 2 + F.col("hour") * 0.01, "far": -F.col("k")})
    found = clusters(matrix(spearman(df, names), names))
    return spark.createDataFrame(list(zip(names, found, strict=True)), "feature string, cluster long")


def label_type_guess(spark, sf):
    df = flows(spark, sf)
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in ("label", "hour", "k")])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("target"), F.when(F.col(c) > 20, "regressor").otherwise("classifier").alias("task")) for c in ("label", "hour", "k")])).alias("t")).select("t.*")


QUERIES = {
    "live_workers": (live_workers, f"WITH {_BEATS} SELECT worker_name, max(at_s) AS at_s, CAST({_NOW} - max(at_s) <= 120 AS BIGINT) AS live FROM beats GROUP BY worker_name"),
    "task_status": (task_status, f"WITH {_TASKS} SELECT task_id, job_id, worker_name, status, at_s FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY at_s DESC) = 1"),
    "task_counts": (task_counts, f"WITH {_TASKS}, l AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY at_s DESC) = 1) SELECT status, count(*) AS n FROM l GROUP BY status"),
    "round_barrier": (round_barrier, f"WITH {_TASKS}, l AS (SELECT * FROM tasks QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY at_s DESC) = 1) SELECT count(*) FILTER (WHERE status = 'COMPLETED') AS done, 4::BIGINT AS expected, CAST(count(*) FILTER (WHERE status = 'COMPLETED') >= 4 AS BIGINT) AS passed FROM l"),
    "task_retries": (task_retries, f"WITH {_TASKS}, l AS (SELECT task_id, count(*) FILTER (WHERE status = 'FAILED') AS attempts, arg_max(status, at_s) AS status FROM tasks GROUP BY task_id) SELECT task_id, attempts, CAST(attempts <= 3 AS BIGINT) AS retry FROM l WHERE status = 'FAILED'"),
    "tasks_of_worker": (tasks_of_worker, f"WITH {_TASKS} SELECT task_id, status FROM tasks WHERE job_id = 'j1' AND worker_name = 'w3'"),
    "resume_missing": (resume_missing, f"WITH {_TASKS} SELECT DISTINCT task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM tasks WHERE status = 'COMPLETED')"),
    "put_if_absent": (put_if_absent, f"WITH {_JOBS} SELECT DISTINCT concat('j', user_id * 2) AS job_id, 'QUEUED' AS status, 99.0::DOUBLE AS at_s FROM flows WHERE concat('j', user_id * 2) NOT IN (SELECT job_id FROM jobs)"),
    "job_latest": (job_latest, f"WITH {_JOBS} SELECT job_id, status, at_s FROM jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_s DESC) = 1"),
    "job_state": (
        job_state,
        f"""WITH RECURSIVE {_JOBS}, turns AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_s, status) AS n FROM jobs),
  fold AS (SELECT DISTINCT job_id, 0 AS n, NULL::VARCHAR AS status, 0 AS ignored FROM jobs UNION ALL
  SELECT job_id, n, CASE WHEN ok THEN new ELSE old END, ignored + CASE WHEN ok THEN 0 ELSE 1 END FROM (SELECT t.job_id, t.n, t.status AS new, f.status AS old, f.ignored,
   CASE WHEN f.status IS NULL THEN t.status = 'QUEUED' ELSE (f.status, t.status) IN (('QUEUED', 'PROCESSING'), ('QUEUED', 'FAILED'), ('PROCESSING', 'COMPLETED'), ('PROCESSING', 'FAILED'), ('PROCESSING', 'PROCESSING'), ('FAILED', 'QUEUED')) END AS ok
   FROM fold f JOIN turns t ON t.job_id = f.job_id AND t.n = f.n + 1))
  SELECT job_id, status, ignored::BIGINT AS ignored FROM fold QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1""",
    ),
    "lock_history": (lock_history, f"WITH RECURSIVE {_HISTORY} SELECT lock_key, at_s, owner, action, granted::BIGINT AS granted, holder, expires_at FROM fold WHERE n > 0"),
    "lock_owner": (lock_owner, f"WITH RECURSIVE {_HISTORY}, {_OWNERS} SELECT lock_key, owner FROM owners"),
    "orphan_jobs": (orphan_jobs, f"WITH RECURSIVE {_HISTORY}, {_OWNERS}, {_JOBS_ONLY}, l AS (SELECT job_id, arg_max(status, at_s) AS status FROM jobs GROUP BY job_id) SELECT job_id FROM l WHERE status = 'PROCESSING' AND job_id NOT IN (SELECT lock_key FROM owners WHERE owner IS NOT NULL)"),
    "queue_state": (
        queue_state,
        f"WITH {FLOWS}, {_log('sent', MESSAGES)}, m AS (SELECT message_id, min(sent_at) AS sent_at FROM sent GROUP BY message_id), {_log('r', RECEIPTS)}, l AS (SELECT message_id, max(at_s) AS seen, bool_or(action = 'delete') AS gone FROM r GROUP BY message_id) SELECT message_id, sent_at, CASE WHEN seen IS NULL THEN 'waiting' WHEN {_NOW} - seen < 180 THEN 'in_flight' ELSE 'returned' END AS state FROM m LEFT JOIN l USING (message_id) WHERE NOT coalesce(gone, FALSE)",
    ),
    "daily_alarm_rate": (daily_alarm_rate, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS fp, round(count(*) FILTER (WHERE value >= 50) / count(*)::DOUBLE, 6) AS rate FROM events WHERE event_type <> 'error' GROUP BY 1"),
    "run_fingerprint": (run_fingerprint, f"WITH {_RUNS} SELECT mode AS run, array_to_string(list_sort(list(DISTINCT trees)), ',') AS trees, array_to_string(list_sort(list(DISTINCT test_size)), ',') AS test_size, array_to_string(list_sort(list(DISTINCT task)), ',') AS task FROM runs GROUP BY mode"),
    "best_run": (best_run, f"WITH {_RUNS} SELECT mode, run FROM runs QUALIFY row_number() OVER (PARTITION BY mode ORDER BY environment = 'cloud' DESC, coverage DESC, scenarios DESC, mtime DESC, run) = 1"),
    "best_run_coverage": (best_run_coverage, f"WITH {_RUNS} SELECT mode, run FROM runs QUALIFY row_number() OVER (PARTITION BY mode ORDER BY coverage DESC, environment = 'cloud' DESC, scenarios DESC, mtime DESC, run) = 1"),
    "run_mode": (run_mode, "SELECT name, CASE WHEN lower(name) LIKE '%federated%' THEN 'federated' WHEN lower(name) LIKE '%centralized%' THEN 'centralized' ELSE 'unknown' END AS mode FROM (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'Test_Federated_' WHEN 1 THEN 'centralized-' ELSE 'x' END || (o_custkey % 100) || '.json' AS name FROM orders)"),
    "usable_runs": (usable_runs, "SELECT DISTINCT o_orderpriority AS scenario, CASE WHEN o_orderkey % 4 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey % 4 = 0 OR o_orderstatus NOT IN ('F', 'P')"),
    "first_metrics": (first_metrics, "WITH m AS (SELECT 'r' || (o_custkey % 50) AS run, CASE o_orderpriority WHEN '1-URGENT' THEN 'performance' WHEN '2-HIGH' THEN 'scaling' ELSE 'network' END AS scenario, o_orderkey AS workers, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS value FROM orders) SELECT run, scenario, workers, value FROM m WHERE value IS NOT NULL AND scenario IN ('performance', 'scaling') QUALIFY row_number() OVER (PARTITION BY run ORDER BY scenario, workers DESC) = 1"),
    "scaling_speedup": (scaling_speedup, f"WITH {_SERIES}, b AS (SELECT *, first_value(seconds) OVER w AS t0, first_value(workers) OVER w AS n0 FROM series WINDOW w AS (PARTITION BY run ORDER BY workers)) SELECT run, workers, seconds, round(t0 / seconds, 6) AS speedup, round(t0 / seconds / workers * n0, 6) AS efficiency, round(t0 * n0 / workers, 6) AS ideal_seconds FROM b"),
    "single_node_speedup": (single_node_speedup, f"WITH {_SERIES} , single AS (SELECT trees, max(seconds) * 4 AS single_seconds FROM series GROUP BY trees HAVING count(*) > 1) SELECT run, workers, single_seconds / seconds AS speedup_single FROM series LEFT JOIN single USING (trees)"),
    "ideal_throughput": (ideal_throughput, f"WITH {_SERIES}, r AS (SELECT run, workers, trees / seconds AS rate FROM series) SELECT run, workers, round(rate, 6) AS rate, round(first_value(r.rate) OVER w * workers / first_value(workers) OVER w, 6) AS ideal FROM r WINDOW w AS (PARTITION BY run ORDER BY workers)"),
    "throughput": (throughput, "SELECT run, trees, samples, seconds, coalesce(trees / nullif(seconds, 0), 0) AS trees_per_s, coalesce(samples / nullif(seconds, 0), 0) AS samples_per_s FROM (SELECT 's' || (l_suppkey % 20) AS run, count(*) AS trees, sum(l_quantity)::BIGINT AS samples, max(CASE WHEN l_suppkey % 20 % 7 > 0 THEN l_linenumber ELSE 0 END)::DOUBLE AS seconds FROM lineitem GROUP BY 1)"),
    "time_breakdown": (
        time_breakdown,
        "WITH p AS (SELECT 's' || r AS run, CASE WHEN r % 6 = 0 THEN 0.0::DOUBLE ELSE grow * 1.5::DOUBLE END AS total, load, grow, CASE WHEN r % 5 > 0 THEN lines::DOUBLE END AS save FROM (SELECT l_suppkey % 40 AS r, min(l_quantity) AS load, max(l_quantity) AS grow, max(l_linenumber) AS lines FROM lineitem GROUP BY 1)), l AS (SELECT run, total, 'load' AS phase, load AS seconds FROM p UNION ALL SELECT run, total, 'grow', grow FROM p UNION ALL SELECT run, total, 'save', coalesce(save, 0) FROM p UNION ALL SELECT run, total, 'unaccounted', greatest(0, total - load - grow - coalesce(save, 0)) FROM p) SELECT run, phase, seconds, round(coalesce(seconds * 100 / nullif(total, 0), 0), 6) AS percent FROM l",
    ),
    "fault_overhead": (
        fault_overhead,
        f"WITH f AS ({_status_sql(30, SCENARIOS, 'scenario')}), c AS (SELECT run, seconds / trees AS q FROM f WHERE scenario = 'clean') SELECT f.run, scenario, round(seconds / trees, 6) AS per_tree, round(q, 6) AS clean_per_tree, round((seconds / trees - q) / q * 100, 6) AS overhead_percent FROM f LEFT JOIN c USING (run) WHERE scenario <> 'clean'",
    ),
    "environment_comparison": (environment_comparison, f"WITH {_RUNS}, b AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY environment ORDER BY coverage DESC, mtime DESC, run) = 1) SELECT environment, run, CASE WHEN (SELECT count(DISTINCT trees) FROM b) = 1 THEN seconds END AS seconds FROM b"),
    "network_impact": (network_impact, f"WITH n AS ({_status_sql(60, PHASE, 'phase')}) SELECT a.run, a.seconds AS clean, b.seconds AS degraded, b.seconds / a.seconds AS slowdown FROM n a JOIN n b ON a.run = b.run AND a.phase = 'clean' AND b.phase = 'degraded'"),
    "metric_deltas": (
        metric_deltas,
        f"""WITH {FLOWS}, m AS (SELECT user_id % 2 AS part, max(value) AS f1_score, count(*) FILTER (label = 1) / count(*)::DOUBLE AS accuracy, max(hour)::DOUBLE AS mse FROM flows GROUP BY 1), l AS (UNPIVOT m ON f1_score, accuracy, mse INTO NAME metric VALUE value)
  SELECT a.metric, round(a.value, 6) AS distributed, round(b.value, 6) AS baseline, round(a.value - b.value, 6) AS delta FROM l a JOIN l b ON a.metric = b.metric AND a.part = 0 AND b.part = 1""",
    ),
    "latency_stats": (latency_stats, f"WITH {FLOWS}, p AS (SELECT 'w' || (user_id % 9) AS worker, value AS ms FROM flows) SELECT worker, count(*) AS probes, min(ms) AS least, max(ms) AS most, round(avg(ms), 6) AS mean, round(median(ms), 6) AS median FROM p GROUP BY GROUPING SETS ((worker), ())"),
    "row_count_summary": (row_count_summary, f"WITH {FLOWS}, c AS (SELECT count(*) AS n FROM flows GROUP BY subtype) SELECT sum(n)::BIGINT AS total, CAST(floor(avg(n)) AS BIGINT) AS mean, min(n) AS least, max(n) AS most FROM c"),
    "importance_watchlist": (importance_watchlist, f"WITH {FLOWS}, i AS (SELECT 'u' || k AS feature, max(value) - 300 AS importance, (k % 3 = 0)::BIGINT AS watched FROM flows GROUP BY k) SELECT feature, round(importance, 6) AS importance, watched FROM i WHERE importance > 0 ORDER BY i.importance DESC, feature LIMIT 20"),
    "ward_clusters": (ward_clusters, None),
    "label_type_guess": (label_type_guess, f"WITH {FLOWS}, c AS (SELECT count(DISTINCT label) AS label, count(DISTINCT hour) AS hour, count(DISTINCT k) AS k FROM flows) SELECT target, CASE WHEN n > 20 THEN 'regressor' ELSE 'classifier' END AS task FROM (UNPIVOT c ON label, hour, k INTO NAME target VALUE n)"),
}
