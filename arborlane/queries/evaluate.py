from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from .base import FLOWS, SCORED, flows, scored


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def confusion(spark, sf):
    return m.confusion(scored(spark, sf), "y", "yhat")


def confusion_normalised(spark, sf):
    df = flows(spark, sf).withColumns({"y": F.col("hour") % 3, "yhat": F.col("k") % 4})
    return _round(m.normalised_confusion(m.confusion(df, "y", "yhat")), "share").select("truth", "prediction", "n", "share")


def class_metrics(spark, sf):
    df = m.binary_metrics(scored(spark, sf))
    return _round(df, "accuracy", "precision", "recall", "f1", "fpr")


def headline_metrics(spark, sf):
    df = flows(spark, sf).withColumns({"y": F.col("hour") % 3, "yhat": F.col("k") % 3})
    return _round(m.headline_metrics(df), "accuracy", "precision", "recall", "f1")


def classification_report(spark, sf):
    df = flows(spark, sf).withColumns({"y": F.col("hour") % 3, "yhat": F.col("k") % 3})
    return _round(m.classification_report(df), "precision", "recall", "f1")


def regression_metrics(spark, sf):
    df = flows(spark, sf).withColumn("yhat", F.col("hour") * 2.0 + F.col("k") * 0.5)
    return _round(m.regression_metrics(df, "value", "yhat"), "mse", "rmse", "mae", "r2")


def auc_rank(spark, sf):
    return _round(m.auc(scored(spark, sf)), "auc")


def pr_curve(spark, sf):
    c = m.curve(scored(spark, sf))
    return _round(c, "precision", "recall", "f1", "fpr").select("threshold", "tp", "fp", "precision", "recall", "f1", "fpr")


def f1_threshold(spark, sf):
    return _round(m.f1_threshold(m.curve(scored(spark, sf))), "precision", "recall", "f1")


def fpr_threshold(spark, sf):
    return _round(m.fpr_threshold(m.curve(scored(spark, sf))), "precision", "recall", "fpr")


def threshold_scan(spark, sf):
    df = scored(spark, sf).withColumn("p", F.col("hour") / F.lit(24.0))
    return _round(m.threshold_scan(df), "precision", "recall", "f1").withColumn("is_best", F.col("is_best").cast("long"))


def threshold_comparison(spark, sf):
    df = scored(spark, sf)
    out = m.compare_thresholds(df, {"default": 0.5, "f1": 0.1, "fpr": 0.9}, "default")
    return _round(out, "precision", "recall", "f1", "fpr", "precision_delta", "recall_delta", "f1_delta", "fpr_delta")


def errors_at_points(spark, sf):
    return m.errors_at(scored(spark, sf), {"default": 0.5, "f1": 0.1, "fpr": 0.9}, "subtype", "day")


def pooled_threshold(spark, sf):
    return _round(m.pooled_threshold(scored(spark, sf)), "precision", "recall", "f1")


def per_worker_threshold(spark, sf):
    return _round(m.worker_thresholds(scored(spark, sf), least_auc=0.5), "auc").withColumn("own", F.col("own").cast("long"))


def resolved_thresholds(spark, sf):
    own = m.worker_thresholds(scored(spark, sf), least_auc=0.5).where("own")
    return m.resolved_thresholds(spark.range(7).select(F.col("id").alias("worker")), own, None, 0.42)


def per_worker_metrics(spark, sf):
    df = m.worker_metrics(scored(spark, sf))
    return _round(df, "accuracy", "precision", "recall", "f1", "fpr", "auc")


def macro_average(spark, sf):
    return _round(m.macro_average(m.worker_metrics(scored(spark, sf)), ["accuracy", "f1", "auc"], "smallest"), "accuracy", "f1", "auc")


def trial_spread(spark, sf):
    return _round(m.spread(flows(spark, sf), ["subtype"], "value", 3), "mean", "deviation")


def class_distribution(spark, sf):
    return _round(m.class_distribution(flows(spark, sf), "subtype"), "share", "imbalance")


def density_bins(spark, sf):
    from ..plans.reports import density

    df = flows(spark, sf).withColumn("yhat", F.col("hour") * 20.0)
    return density(df, "value", "yhat", 12)


_COUNTS = "count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND yhat <> 1) AS tn"
_RATES = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS fpr"""
_CURVE = SCORED + """, s AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY p),
  c AS (SELECT p AS threshold, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM s),
  curve AS (SELECT threshold, tp, fp, pp, nn, tp / (tp + fp)::DOUBLE AS precision, tp / pp::DOUBLE AS recall, 2 * tp / (tp + fp + pp)::DOUBLE AS f1, fp / nn::DOUBLE AS fpr FROM c)"""
_AUC = "sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0)"
_WORKER_AUC = f"""wa AS (SELECT worker, {_AUC} AS auc FROM (SELECT worker, pos, neg, coalesce(sum(neg) OVER (PARTITION BY worker ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT worker, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY worker, p)) GROUP BY worker)"""
_WORKER_T = f"""{SCORED}, {_WORKER_AUC}, ws AS (SELECT worker, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY worker, p),
  wc AS (SELECT worker, p, sum(pos) OVER (PARTITION BY worker ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY worker ORDER BY p DESC) AS fp, sum(pos) OVER (PARTITION BY worker) AS pp, sum(neg) OVER (PARTITION BY worker) AS nn FROM ws),
  wb AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY 2 * tp / (tp + fp + pp)::DOUBLE DESC, p) AS r FROM wc),
  gs AS (SELECT p, sum(pos) AS pos, sum(neg) AS neg FROM ws GROUP BY p), gc AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS pp FROM gs),
  gt AS (SELECT p FROM gc ORDER BY 2 * tp / (tp + fp + pp)::DOUBLE DESC, p LIMIT 1),
  wt AS (SELECT worker, pp > 0 AND nn > 0 AND pp + nn >= 30 AND auc >= 0.5::DOUBLE AS own, p, CAST(pp + nn AS BIGINT) AS n_val_samples, auc FROM wb JOIN wa USING (worker) WHERE r = 1)"""
_THREE = f"""three AS (SELECT label, tp, predicted, support, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1
  FROM (SELECT l AS label, count(*) FILTER (WHERE hour % 3 = l AND k % 3 = l) AS tp, count(*) FILTER (WHERE k % 3 = l) AS predicted, count(*) FILTER (WHERE hour % 3 = l) AS support FROM flows, (SELECT range AS l FROM range(3)) GROUP BY l))"""
_AT = "unnest([0.5, 0.1, 0.9]::DOUBLE[]) AS threshold, unnest(['default', 'f1', 'fpr']) AS name"

QUERIES = {
    "confusion": (confusion, f"WITH {SCORED}, l AS (SELECT y AS c FROM scored UNION SELECT yhat FROM scored) SELECT a.c AS truth, b.c AS prediction, (SELECT count(*) FROM scored WHERE y = a.c AND yhat = b.c) AS n FROM l a, l b"),
    "confusion_normalised": (
        confusion_normalised,
        f"""WITH {FLOWS}, l AS (SELECT hour % 3 AS c FROM flows UNION SELECT k % 4 FROM flows), g AS (SELECT hour % 3 AS y, k % 4 AS yhat, count(*) AS n FROM flows GROUP BY 1, 2),
  f AS (SELECT a.c AS truth, b.c AS prediction, coalesce(g.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN g ON g.y = a.c AND g.yhat = b.c)
  SELECT truth, prediction, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0)::DOUBLE, 0), 6) AS share FROM f""",
    ),
    "class_metrics": (class_metrics, f"WITH {SCORED}, c AS (SELECT {_COUNTS} FROM scored) SELECT tp, fp, fn, tn, {_RATES} FROM c"),
    "headline_metrics": (
        headline_metrics,
        f"WITH {FLOWS}, {_THREE} SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM three",
    ),
    "classification_report": (
        classification_report,
        f"""WITH {FLOWS}, {_THREE}, rows AS (SELECT CAST(label AS VARCHAR) AS name, precision, recall, f1, support FROM three
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE, sum(support) FROM three
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM three
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM three)
  SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM rows""",
    ),
    "regression_metrics": (
        regression_metrics,
        f"WITH {FLOWS}, e AS (SELECT value, value - (hour * 2.0::DOUBLE + k * 0.5::DOUBLE) AS e FROM flows) SELECT count(*) AS n, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - sum(e * e) / (count(*) * var_pop(value)), 6) AS r2 FROM e",
    ),
    "auc_rank": (
        auc_rank,
        f"WITH {SCORED} SELECT round({_AUC}, 6) AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM scored GROUP BY p))",
    ),
    "pr_curve": (pr_curve, f"WITH {_CURVE} SELECT threshold, tp, fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM curve"),
    "f1_threshold": (f1_threshold, f"WITH {_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (ORDER BY curve.f1 DESC, threshold) AS r FROM curve) WHERE r = 1"),
    "fpr_threshold": (
        fpr_threshold,
        f"WITH {_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM (SELECT *, row_number() OVER (ORDER BY curve.recall DESC, threshold DESC) AS r FROM curve WHERE curve.fpr <= 0.01::DOUBLE) WHERE r = 1",
    ),
    "threshold_scan": (
        threshold_scan,
        f"""WITH {FLOWS}, t AS (SELECT round(0.20::DOUBLE + 0.05::DOUBLE * range, 2) AS threshold FROM range(11)), c AS (SELECT threshold, count(*) FILTER (WHERE label = 1 AND hour / 24.0::DOUBLE >= threshold) AS tp, count(*) FILTER (WHERE label <> 1 AND hour / 24.0::DOUBLE >= threshold) AS fp, count(*) FILTER (WHERE label = 1 AND hour / 24.0::DOUBLE < threshold) AS fn FROM flows, t GROUP BY threshold),
  r AS (SELECT threshold, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM c)
  SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(r.f1, 6) AS f1, CAST(row_number() OVER (ORDER BY r.f1 DESC, threshold) = 1 AS BIGINT) AS is_best FROM r""",
    ),
    "threshold_comparison": (
        threshold_comparison,
        f"""WITH {SCORED}, t AS (SELECT {_AT}), c AS (SELECT name, threshold, count(*) FILTER (WHERE y = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE y <> 1 AND p >= threshold) AS fp, count(*) FILTER (WHERE y = 1 AND p < threshold) AS fn, count(*) FILTER (WHERE y <> 1 AND p < threshold) AS tn FROM scored, t GROUP BY ALL),
  r AS (SELECT name, threshold, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0) AS fpr FROM c)
  SELECT r.name, r.threshold, round(r.precision, 6) AS precision, round(r.recall, 6) AS recall, round(r.f1, 6) AS f1, round(r.fpr, 6) AS fpr, round(r.precision - b.precision, 6) AS precision_delta, round(r.recall - b.recall, 6) AS recall_delta, round(r.f1 - b.f1, 6) AS f1_delta, round(r.fpr - b.fpr, 6) AS fpr_delta
  FROM r, (SELECT * FROM r WHERE name = 'default') b""",
    ),
    "errors_at_points": (
        errors_at_points,
        f"WITH {SCORED}, t AS (SELECT {_AT}) SELECT name AS point, CASE WHEN y = 1 THEN 'fn' ELSE 'fp' END AS kind, CASE WHEN y = 1 THEN subtype ELSE day END AS grp, count(*) AS n, count(*) FILTER (WHERE (p >= threshold) <> (y = 1)) AS errors FROM scored, t GROUP BY 1, 2, 3",
    ),
    "pooled_threshold": (
        pooled_threshold,
        f"WITH {_CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(pp + nn AS BIGINT) AS n_val_samples FROM (SELECT *, row_number() OVER (ORDER BY curve.f1 DESC, threshold) AS r FROM curve) WHERE r = 1 AND pp > 0 AND nn > 0 AND pp + nn >= 30",
    ),
    "per_worker_threshold": (per_worker_threshold, f"WITH {_WORKER_T} SELECT worker, CAST(own AS BIGINT) AS own, CASE WHEN own THEN wt.p ELSE (SELECT p FROM gt) END AS threshold, n_val_samples, round(auc, 6) AS auc FROM wt"),
    "resolved_thresholds": (
        resolved_thresholds,
        f"WITH {_WORKER_T} SELECT range AS worker, coalesce(wt.p, 0.42::DOUBLE) AS threshold, CASE WHEN wt.p IS NOT NULL THEN 'worker' ELSE 'manifest' END AS origin FROM range(7) LEFT JOIN wt ON wt.worker = range AND wt.own",
    ),
    "per_worker_metrics": (
        per_worker_metrics,
        f"WITH {SCORED}, {_WORKER_AUC}, c AS (SELECT worker, {_COUNTS} FROM scored GROUP BY worker) SELECT worker, tp, fp, fn, tn, {_RATES}, tp + fn AS positives, fp + tn AS negatives, least(tp + fn, fp + tn) AS smallest, round(auc, 6) AS auc FROM c JOIN wa USING (worker)",
    ),
    "macro_average": (
        macro_average,
        f"WITH {SCORED}, {_WORKER_AUC}, c AS (SELECT worker, {_COUNTS} FROM scored GROUP BY worker), r AS (SELECT (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, auc FROM c JOIN wa USING (worker) WHERE least(tp + fn, fp + tn) >= 30) SELECT count(*) AS workers, round(avg(accuracy), 6) AS accuracy, round(avg(f1), 6) AS f1, round(avg(auc), 6) AS auc FROM r",
    ),
    "trial_spread": (trial_spread, f"WITH {FLOWS} SELECT subtype, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM flows GROUP BY subtype ORDER BY avg(value) DESC, subtype LIMIT 3"),
    "class_distribution": (class_distribution, f"WITH {FLOWS}, c AS (SELECT subtype AS label, count(*) AS n FROM flows GROUP BY subtype) SELECT label, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(max(n) OVER () / (min(n) OVER ())::DOUBLE, 6) AS imbalance FROM c"),
    "density_bins": (
        density_bins,
        f"""WITH {FLOWS}, e AS (SELECT value AS y, hour * 20.0::DOUBLE AS yhat FROM flows), b AS (SELECT least(min(y), min(yhat)) AS lo, greatest(max(y), max(yhat)) AS hi FROM e)
  SELECT CAST(least(11, floor((y - lo) / (hi - lo) * 12)) AS BIGINT) AS y_bin, CAST(least(11, floor((yhat - lo) / (hi - lo) * 12)) AS BIGINT) AS yhat_bin, count(*) AS n FROM e, b GROUP BY 1, 2""",
    ),
}
