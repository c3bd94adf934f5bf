from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, metrics, sampling, selection
from .base import FLOWS, flows, h, rank, size

def raw(spark, sf):
    """Events as an untidy text table: repeated headers, lost labels, words and infinities among numbers."""
    df, e = flows(spark, sf), F.col("event_id")
    header = e % 13 == 0
    text = lambda c: F.when(header, "header").otherwise(c)
    label = F.when(header, "Label").when(e % 13 == 1, None).when(e % 13 == 2, " Benign ").when(F.col("label") == 1, "Bot").otherwise("Benign")
    std = F.when(e % 17 == 0, "NaN").when(e % 17 == 1, "Infinity").when(e % 17 == 2, "abc").otherwise(F.floor(F.col("value") * 4).cast("string"))
    return df.select(e.alias("id"), label.alias("Label"), text(std).alias("std"), text(F.col("hour").cast("string")).alias("mean"), text(F.col("k").cast("string")).alias("syn"), text((F.col("user_id") % 5 - 1).cast("string")).alias("ack"), F.concat(F.lit("10.0.0."), F.col("user_id") % 200).alias("Src IP"), text((F.col("hour") * 10).cast("string")).alias("Score"))


RAW_SQL = FLOWS + """, raw AS (SELECT event_id AS id, CASE event_id % 13 WHEN 0 THEN 'Label' WHEN 1 THEN NULL WHEN 2 THEN ' Benign ' ELSE CASE WHEN label = 1 THEN 'Bot' ELSE 'Benign' END END AS "Label",
  CASE WHEN event_id % 13 = 0 THEN 'header' ELSE CASE event_id % 17 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN 'abc' ELSE floor(value * 4)::BIGINT::VARCHAR END END AS std,
  CASE WHEN event_id % 13 = 0 THEN 'header' ELSE hour::VARCHAR END AS mean, CASE WHEN event_id % 13 = 0 THEN 'header' ELSE k::VARCHAR END AS syn,
  CASE WHEN event_id % 13 = 0 THEN 'header' ELSE (user_id % 5 - 1)::VARCHAR END AS ack, '10.0.0.' || (user_id % 200) AS "Src IP", CASE WHEN event_id % 13 = 0 THEN 'header' ELSE (hour * 10)::VARCHAR END AS "Score" FROM flows)"""


def _numbers(spark, sf):
    df = clean.drop_header_rows(raw(spark, sf))
    names = {"std": "Flow IAT Std", "mean": "Flow IAT Mean", "syn": "SYN Flag Cnt", "ack": "ACK Flag Cnt"}
    df = clean.drop_metadata(df).withColumnsRenamed(names).withColumns({"Fwd IAT Std": F.col("Flow IAT Std"), "Fwd IAT Mean": F.col("Flow IAT Mean")})
    return clean.derive(clean.coerce_numeric(df, keep=("Label", "id")))


_NUMBERS = RAW_SQL + """, numbers AS (SELECT id, trim("Label") AS label, TRY_CAST(std AS DOUBLE) AS std, TRY_CAST(mean AS DOUBLE) AS mean, TRY_CAST(syn AS DOUBLE) AS syn, TRY_CAST(ack AS DOUBLE) AS ack,
  TRY_CAST("Score" AS DOUBLE) AS score FROM raw WHERE "Label" IS NULL OR trim("Label") <> 'Label')"""


def coerce_numeric(spark, sf):
    df = clean.coerce_numeric(clean.drop_metadata(clean.drop_header_rows(raw(spark, sf))), keep=("Label", "id"))
    return df.select("id", F.col("Label").alias("label"), F.nanvl("std", F.lit(-1.0)).alias("std"), "mean", "syn", "ack", F.col("Score").alias("score"))


def derive_ratios(spark, sf):
    return _numbers(spark, sf).select("id", F.nanvl("Flow IAT CV", F.lit(-1.0)).alias("flow_cv"), F.nanvl("Fwd IAT CV", F.lit(-1.0)).alias("fwd_cv"), F.col("SYN_ACK_Ratio").alias("syn_ack"))


def drop_invalid(spark, sf):
    df = _numbers(spark, sf)
    return clean.drop_invalid(df).select("id", clean.binarise("Label").cast("long").alias("label"))


def process_pipeline(spark, sf):
    df = clean.trim_columns(raw(spark, sf).withColumnRenamed("Label", " label "))
    df = clean.drop_header_rows(clean.rename_target(df))
    names = {"std": "Flow IAT Std", "mean": "Flow IAT Mean", "syn": "SYN Flag Cnt", "ack": "ACK Flag Cnt"}
    df = df.withColumnsRenamed(names).withColumns({"Fwd IAT Std": F.col("Flow IAT Std"), "Fwd IAT Mean": F.col("Flow IAT Mean"), "Label": clean.binarise("Label")})
    out = clean.process(df)
    return out.select(F.col("id").cast("long").alias("id"), F.col("Label").cast("long").alias("label"), F.col("SYN_ACK_Ratio").alias("syn_ack"), F.lit(len(out.columns)).cast("long").alias("n_columns"))


def valid_rows_aligned(spark, sf):
    df = clean.drop_header_rows(raw(spark, sf)).drop("Src IP")
    return clean.valid_with_side(df, ["Label", "id"]).select("id", F.col("Label").alias("label"))


def binarize_balance(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select(clean.binarise("event_type", "error").cast("long").alias("Label"))
    return clean.class_balance(df).select("label", "n", F.round("percent", 6).alias("percent"))


def day_distribution(spark, sf):
    return sampling.distribution(flows(spark, sf), "day")


def constant_features(spark, sf):
    df = flows(spark, sf).withColumns({"same": F.lit(3.0), "zero": F.col("k") * 0})
    return selection.variances(df, ["value", "hour", "k", "same", "zero"]).select("feature", (F.col("variance") == 0).cast("long").alias("is_constant"))


def fn_by_subtype(spark, sf):
    df = flows(spark, sf).withColumns({"y": (F.col("k") % 2), "yhat": (F.col("value") >= 50).cast("long")})
    return metrics.misses_by(df, "subtype").withColumn("recall", F.round("recall", 6))


def fp_by_day(spark, sf):
    df = flows(spark, sf).withColumns({"y": (F.col("k") % 2), "yhat": (F.col("value") >= 50).cast("long")})
    return metrics.false_alarms_by(df, "day").withColumn("rate", F.round("rate", 6))


DAY_QUOTA, PROTECTED_TARGET = 100, 120
PROTECTED = ["2024-01-03", "2024-01-17"]


def day_quota_sample(spark, sf):
    return sampling.quota_sample(flows(spark, sf), "event_id", "day", DAY_QUOTA).select("event_id", "day")


def day_fraction(spark, sf):
    return sampling.day_fractions(flows(spark, sf), "day", 200).select("day", "n", F.round("fraction", 6).alias("fraction"))


def source_fraction_sample(spark, sf):
    return sampling.fraction_sample(flows(spark, sf), "event_id", "subtype", 0.1).select("event_id", "subtype")


def protected_rebalance(spark, sf):
    return sampling.protected_rebalance(flows(spark, sf), "event_id", "day", PROTECTED, F.col("label") == 0, PROTECTED_TARGET).select("event_id", "day", "label")


def stratified_split(spark, sf):
    return sampling.stratified_split(flows(spark, sf), "event_id", "label").select("event_id", "label", "split")


def random_split(spark, sf):
    return sampling.random_split(flows(spark, sf), "event_id").select("event_id", "split")


def _train(spark, sf):
    return sampling.split_by_rank(flows(spark, sf), "event_id", ("label",), 0.2, 123).where("split = 'train'")


_TRAIN = FLOWS + f""", ranked AS (SELECT *, {rank('123', 'event_id', 'label')} AS r, {size('label')} AS s FROM flows),
  train AS (SELECT * FROM ranked WHERE NOT (s > 1 AND r <= round_even(s * 0.2::DOUBLE, 0)))"""


def validation_carve(spark, sf):
    return sampling.validation_carve(_train(spark, sf), "event_id", "label").select("event_id", "part")


def undersample(spark, sf):
    return sampling.undersample(_train(spark, sf), "event_id", "label", 1.5).select("event_id", "label")


def diagnostic_sample(spark, sf):
    return sampling.absolute_sample(flows(spark, sf), "event_id", "label", 1000).select("event_id", "label")


def prediction_sample(spark, sf):
    return sampling.prediction_sample(flows(spark, sf), "event_id", 500).select("event_id", "sample_size", "population_size")


def shard_iid(spark, sf):
    return sampling.shard_iid(flows(spark, sf), "event_id", 7).select("event_id", "shard_id")


def shard_by_day(spark, sf):
    return sampling.shard_by_day(flows(spark, sf), "day", 4).groupBy("day", "shard_id").agg(F.count("*").alias("n"))


def shard_stratified(spark, sf):
    return sampling.shard_stratified(flows(spark, sf), "event_id", "label").select("event_id", "shard_id")


def shard_plain(spark, sf):
    return sampling.shard_plain(flows(spark, sf), "event_id", 7).select("event_id", "shard_id")


def _users(spark, sf, n: int, name: str):
    """The remainders of user ids, as numbers of shards, tasks or workers."""
    return flows(spark, sf).select((F.col("user_id") % n).alias(name)).distinct()


def _user_count(spark, sf) -> int:
    return flows(spark, sf).agg(F.count_distinct("user_id")).first()[0]


_USERS = FLOWS + ", u AS (SELECT count(DISTINCT user_id) AS trees FROM flows)"


def shard_task_assignment(spark, sf):
    return sampling.assign_shards(_users(spark, sf, 20, "shard_id"), _users(spark, sf, 9, "task_id"), 6)


def usable_shard_size(spark, sf):
    df = flows(spark, sf).withColumns({"shard_id": F.col("user_id") % 6, "label": F.when(F.col("user_id") % 6 == 5, 0).otherwise(F.col("label"))})
    return sampling.usable_size(df, "shard_id", "label", 1.5, 0.75)


def synthetic_quota(spark, sf):
    return sampling.quotas(_users(spark, sf, 7, "worker"), flows(spark, sf).count(), "worker")


def _sizes(spark, sf):
    """Rows of six workers; two are unknown and one is empty."""
    w = F.col("worker")
    sizes = flows(spark, sf).groupBy((F.col("user_id") % 6).alias("worker")).agg(F.count("*").alias("n"))
    return sizes.select("worker", F.when(w.isin(1, 5), None).when(w == 2, 0).otherwise(F.col("n")).cast("long").alias("size"))


_SIZES = FLOWS + ", sizes AS (SELECT user_id % 6 AS worker, CASE WHEN user_id % 6 IN (1, 5) THEN NULL WHEN user_id % 6 = 2 THEN 0 ELSE count(*) END AS size FROM flows GROUP BY user_id % 6)"


def tree_quota_proportional(spark, sf):
    return sampling.tree_quotas(_sizes(spark, sf), 100)


def tree_quota_equal(spark, sf):
    return sampling.tree_quotas(_sizes(spark, sf), 100, equal=True)


def tree_chunks(spark, sf):
    rows = [(k, *c) for k, c in enumerate(sampling.tree_chunks(_user_count(spark, sf), 7))]
    return spark.createDataFrame(rows, "chunk long, first long, last long")


def round_steps(spark, sf):
    rows = [(k, *c) for k, c in enumerate(sampling.round_steps(_user_count(spark, sf), 3))]
    return spark.createDataFrame(rows, "step long, first long, last long")


def discard_trees(spark, sf):
    return sampling.discard_surplus(flows(spark, sf).select(F.col("user_id").alias("tree_id")).distinct(), 12)


def worker_subset(spark, sf):
    workers = flows(spark, sf).select((F.col("user_id") % 20).alias("worker")).distinct()
    return sampling.discard_surplus(workers, 5, "worker", 7)


def _gaps(spark, sf):
    """Flows with values missing here and there."""
    df = flows(spark, sf)
    return df.select(F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 > 0, F.col("hour")).alias("hour"), "k")


def spearman_nulls(spark, sf):
    return selection.spearman(_gaps(spark, sf), ["value", "hour", "k"]).select("a", "b", F.round("rho", 6).alias("rho"))


_GAPS = FLOWS + ", gaps AS (SELECT CASE WHEN event_id % 7 > 0 THEN value END AS value, CASE WHEN event_id % 5 > 0 THEN hour END AS hour, k FROM flows)"
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS rb FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    for a, b in (("value", "value"), ("value", "hour"), ("value", "k"), ("hour", "hour"), ("hour", "k"), ("k", "k"))
)


def spearman_matrix(spark, sf):
    return selection.spearman(flows(spark, sf), ["value", "hour", "k"]).select("a", "b", F.round("rho", 6).alias("rho"))


def near_equal_sql(r: str, s: str, k: int) -> str:
    return f"CASE WHEN {r} <= ({s} % {k}) * ({s} // {k} + 1) THEN ({r} - 1) // ({s} // {k} + 1) ELSE ({s} % {k}) + ({r} - 1 - ({s} % {k}) * ({s} // {k} + 1)) // greatest({s} // {k}, 1) END"




def _quota_sql(sizes: str) -> str:
    return f"""WITH {_SIZES}, filled AS (SELECT worker, {sizes} AS s FROM sizes), exact AS (SELECT worker, 100.0::DOUBLE * s / sum(s) OVER () AS e FROM filled),
  based AS (SELECT worker, e, CAST(floor(e) AS BIGINT) AS base, 100 - CAST(sum(floor(e)) OVER () AS BIGINT) AS rest FROM exact)
  SELECT CAST(worker AS BIGINT) AS worker, base + CASE WHEN row_number() OVER (ORDER BY round(e - base, 9) DESC, worker) <= rest THEN 1 ELSE 0 END AS trees FROM based"""


_RANKS = ", ".join(f"avg_{c} AS (SELECT {c}, cum - (n - 1) / 2.0::DOUBLE AS r FROM (SELECT {c}, n, sum(n) OVER (ORDER BY {c}) AS cum FROM (SELECT {c}, count(*) AS n FROM flows GROUP BY {c})))" for c in ("value", "hour", "k"))

QUERIES = {
    "binarize_balance": (
        binarize_balance,
        "SELECT CASE WHEN event_type = 'error' THEN 0 ELSE 1 END::BIGINT AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1",
    ),
    "coerce_numeric": (coerce_numeric, f"WITH {_NUMBERS} SELECT id::BIGINT AS id, label, CASE WHEN isnan(std) THEN -1.0::DOUBLE ELSE std END AS std, mean, syn, ack, score FROM numbers"),
    "derive_ratios": (
        derive_ratios,
        f"WITH {_NUMBERS}, r AS (SELECT id, std / nullif(mean, 0) AS cv, syn / nullif(ack + 1, 0) AS sa FROM numbers) SELECT id::BIGINT AS id, CASE WHEN isnan(cv) THEN -1.0::DOUBLE ELSE cv END AS flow_cv, CASE WHEN isnan(cv) THEN -1.0::DOUBLE ELSE cv END AS fwd_cv, sa AS syn_ack FROM r",
    ),
    "drop_invalid": (
        drop_invalid,
        f"WITH {_NUMBERS} SELECT id::BIGINT AS id, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END::BIGINT AS label FROM numbers WHERE label IS NOT NULL AND isfinite(std) AND isfinite(mean) AND mean <> 0 AND ack <> -1 AND isfinite(syn) AND isfinite(score)",
    ),
    "process_pipeline": (
        process_pipeline,
        f"WITH {_NUMBERS} SELECT id::BIGINT AS id, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END::BIGINT AS label, syn / (ack + 1) AS syn_ack, 12::BIGINT AS n_columns FROM numbers WHERE isfinite(std) AND isfinite(mean) AND mean <> 0 AND ack <> -1 AND isfinite(syn) AND isfinite(score)",
    ),
    "valid_rows_aligned": (valid_rows_aligned, f"WITH {_NUMBERS} SELECT id::BIGINT AS id, label FROM numbers WHERE isfinite(std) AND isfinite(mean) AND isfinite(syn) AND isfinite(ack) AND isfinite(score)"),
    "day_distribution": (day_distribution, f"WITH {FLOWS} SELECT day, count(*) AS n FROM flows GROUP BY day"),
    "constant_features": (
        constant_features,
        f"WITH {FLOWS}, v AS (SELECT var_samp(value) AS value, var_samp(hour) AS hour, var_samp(k) AS k, var_samp(3.0) AS same, var_samp(k * 0) AS zero FROM flows) SELECT feature, CAST(variance = 0 AS BIGINT) AS is_constant FROM (UNPIVOT v ON value, hour, k, same, zero INTO NAME feature VALUE variance)",
    ),
    "fn_by_subtype": (
        fn_by_subtype,
        f"WITH {FLOWS} SELECT subtype, count(*) AS n, count(*) FILTER (WHERE value < 50) AS fn, round(1 - count(*) FILTER (WHERE value < 50) / count(*)::DOUBLE, 6) AS recall FROM flows WHERE k % 2 = 1 GROUP BY subtype",
    ),
    "fp_by_day": (fp_by_day, f"WITH {FLOWS} SELECT day, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS fp, round(count(*) FILTER (WHERE value >= 50) / count(*)::DOUBLE, 6) AS rate FROM flows WHERE k % 2 <> 1 GROUP BY day"),
    "day_quota_sample": (day_quota_sample, f"WITH {FLOWS} SELECT event_id, day FROM flows QUALIFY {rank('123', 'event_id', 'day')} <= {DAY_QUOTA}"),
    "day_fraction": (day_fraction, f"WITH {FLOWS} SELECT day, count(*) AS n, round(least(1.0::DOUBLE, 200.0::DOUBLE / count(*)), 6) AS fraction FROM flows GROUP BY day"),
    "source_fraction_sample": (source_fraction_sample, f"WITH {FLOWS} SELECT event_id, subtype FROM flows QUALIFY {rank('123', 'event_id', 'subtype')} <= round_even({size('subtype')} * 0.1::DOUBLE, 0)"),
    "protected_rebalance": (
        protected_rebalance,
        f"""WITH {FLOWS}, kinds AS (SELECT *, CASE WHEN day NOT IN ('{PROTECTED[0]}', '{PROTECTED[1]}') THEN 0 WHEN label = 0 THEN 1 ELSE 2 END AS kind FROM flows),
  ranked AS (SELECT *, {rank('123', 'event_id', 'day, kind')} AS r, count(*) FILTER (WHERE kind = 2) OVER (PARTITION BY day) AS others FROM kinds)
  SELECT event_id, day, label FROM ranked WHERE kind = 2 OR (kind = 1 AND r <= greatest(0, {PROTECTED_TARGET} - others)) OR (kind = 0 AND r <= {PROTECTED_TARGET})""",
    ),
    "stratified_split": (
        stratified_split,
        f"WITH {FLOWS} SELECT event_id, label, CASE WHEN {size('label')} > 1 AND {rank('123', 'event_id', 'label')} <= round_even({size('label')} * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM flows",
    ),
    "random_split": (random_split, f"WITH {FLOWS} SELECT event_id, CASE WHEN {rank('123', 'event_id')} <= round_even({size()} * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM flows"),
    "validation_carve": (
        validation_carve,
        f"WITH {_TRAIN} SELECT event_id, CASE WHEN {size('label')} > 1 AND {rank('123-val', 'event_id', 'label')} <= round_even({size('label')} * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS part FROM train",
    ),
    "undersample": (
        undersample,
        f"WITH {_TRAIN}, sized AS (SELECT *, {rank('123', 'event_id', 'label')} AS q, {size('label')} AS c FROM train) SELECT event_id, label FROM sized WHERE c < (SELECT max(c) FROM sized) OR q <= round_even((SELECT min(c) FROM sized) * 1.5::DOUBLE, 0)",
    ),
    "diagnostic_sample": (diagnostic_sample, f"WITH {FLOWS} SELECT event_id, label FROM flows QUALIFY {size()} <= 1000 OR {rank('123', 'event_id', 'label')} <= round_even({size('label')} * (1000 / {size()}::DOUBLE), 0)"),
    "prediction_sample": (prediction_sample, f"WITH {FLOWS} SELECT event_id, least({size()}, 500)::BIGINT AS sample_size, {size()} AS population_size FROM flows QUALIFY {rank('42', 'event_id')} <= 500"),
    "shard_iid": (shard_iid, f"WITH {FLOWS} SELECT event_id, CAST(({rank('123', 'event_id')} - 1) // CAST(ceil({size()} / 7.0) AS BIGINT) AS BIGINT) AS shard_id FROM flows"),
    "shard_by_day": (shard_by_day, f"WITH {FLOWS} SELECT day, CAST((dense_rank() OVER (ORDER BY day) - 1) % 4 AS BIGINT) AS shard_id, n FROM (SELECT day, count(*) AS n FROM flows GROUP BY day)"),
    "shard_stratified": (shard_stratified, f"WITH {FLOWS} SELECT event_id, ntile(20) OVER (PARTITION BY label ORDER BY {h('123', 'event_id')}, event_id) - 1 AS shard_id FROM flows"),
    "shard_plain": (shard_plain, f"WITH {FLOWS} SELECT event_id, ntile(7) OVER (ORDER BY {h('123', 'event_id')}, event_id) - 1 AS shard_id FROM flows"),
    "shard_task_assignment": (shard_task_assignment, f"WITH {FLOWS}, s AS (SELECT DISTINCT user_id % 20 AS shard_id FROM flows), t AS (SELECT DISTINCT user_id % 9 AS task_id FROM flows) SELECT shard_id, task_id FROM s JOIN t ON shard_id % 6 = task_id % 6"),
    "usable_shard_size": (
        usable_shard_size,
        f"""WITH {FLOWS}, c AS (SELECT user_id % 6 AS shard_id, count(*) FILTER (WHERE label = 1 AND user_id % 6 <> 5) AS ones, count(*) FILTER (WHERE label = 0 OR user_id % 6 = 5) AS zeros FROM flows GROUP BY 1),
  m AS (SELECT shard_id, floor(least(ones, zeros) * 0.75::DOUBLE) AS lo, floor(greatest(ones, zeros) * 0.75::DOUBLE) AS hi, least(ones, zeros) AS minor FROM c)
  SELECT shard_id, CAST(CASE WHEN minor = 0 THEN 0 ELSE lo + least(hi, round_even(lo * 1.5::DOUBLE, 0)) END AS BIGINT) AS usable FROM m""",
    ),
    "synthetic_quota": (synthetic_quota, f"WITH {FLOWS}, w AS (SELECT worker, row_number() OVER (ORDER BY worker) - 1 AS place, count(*) OVER () AS m FROM (SELECT DISTINCT user_id % 7 AS worker FROM flows)), n AS (SELECT count(*) AS n FROM flows) SELECT worker, CAST(n // m + CASE WHEN place < n % m THEN 1 ELSE 0 END AS BIGINT) AS quota FROM w, n"),
    "tree_quota_proportional": (tree_quota_proportional, _quota_sql("coalesce(size, greatest(1.0::DOUBLE, avg(size) OVER ()))")),
    "tree_quota_equal": (tree_quota_equal, _quota_sql("1.0::DOUBLE")),
    "tree_chunks": (tree_chunks, f"WITH {_USERS}, c AS (SELECT trees, ceil(trees / 7.0::DOUBLE)::BIGINT AS step, unnest(range(7)) AS chunk FROM u) SELECT chunk, chunk * step AS first, least(trees, chunk * step + step)::BIGINT AS last FROM c WHERE chunk * step < trees"),
    "round_steps": (round_steps, f"WITH {_USERS}, c AS (SELECT trees, unnest(range(trees // 30 + 1)) AS step FROM u) SELECT step, step * 30 AS first, least(trees, step * 30 + 30)::BIGINT AS last FROM c WHERE step * 30 < trees"),
    "discard_trees": (discard_trees, f"WITH {FLOWS}, t AS (SELECT DISTINCT user_id AS tree_id FROM flows) SELECT tree_id FROM t QUALIFY {rank('123', 'tree_id')} <= 12"),
    "worker_subset": (worker_subset, f"WITH {FLOWS}, w AS (SELECT DISTINCT user_id % 20 AS worker FROM flows) SELECT worker FROM w QUALIFY {rank('7', 'worker')} <= 5"),
    "spearman_nulls": (spearman_nulls, f"WITH {_GAPS} {_PAIRS}"),
    "spearman_matrix": (
        spearman_matrix,
        f"""WITH {FLOWS}, {_RANKS}, j AS (SELECT avg_value.r AS value, avg_hour.r AS hour, avg_k.r AS k FROM flows JOIN avg_value USING (value) JOIN avg_hour USING (hour) JOIN avg_k USING (k))
  SELECT a, b, round(rho, 6) AS rho FROM (SELECT unnest([{{'a': 'value', 'b': 'value', 'rho': corr(value, value)}}, {{'a': 'value', 'b': 'hour', 'rho': corr(value, hour)}}, {{'a': 'value', 'b': 'k', 'rho': corr(value, k)}},
  {{'a': 'hour', 'b': 'hour', 'rho': corr(hour, hour)}}, {{'a': 'hour', 'b': 'k', 'rho': corr(hour, k)}}, {{'a': 'k', 'b': 'k', 'rho': corr(k, k)}}], recursive := true) FROM j)""",
    ),
}
