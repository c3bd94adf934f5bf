"""Metrics, curves, thresholds and error analysis as aggregations.

A prediction table has a truth column `y` (0/1 or class labels), a predicted
column and, for curves, a score `p`.  Curves start from one row for each
distinct score, so their running sums are over scores and not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import running_sums

#: Fixed values of the reference: thresholds that a scan tries, false-positive limit, least rows and least AUC of a worker's own threshold.
SCAN = tuple(round(0.20 + 0.05 * k, 2) for k in range(11))
FPR_LIMIT, LEAST_ROWS, LEAST_AUC, DEFAULT_THRESHOLD = 0.01, 30, 0.65, 0.5


def safe_ratio(above: Column, below: Column) -> Column:
    """0 where the divisor is 0."""
    return F.coalesce(F.try_divide(above.cast("double"), below.cast("double")), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    """truth, prediction, n for every pair of labels that occur in either column, zeros too."""
    counts = df.groupBy(*by, F.col(y).alias("truth"), F.col(yhat).alias("prediction")).agg(F.count("*").alias("n"))
    labels = counts.select(*by, F.explode(F.array("truth", "prediction")).alias("label")).distinct()
    if by:
        grid = labels.withColumnRenamed("label", "truth").join(labels.withColumnRenamed("label", "prediction"), list(by))
    else:  # labels squared: a row for each pair of classes
        all_labels = labels.agg(F.collect_set("label").alias("l"))
        grid = all_labels.select(F.explode("l").alias("truth"), "l").select("truth", F.explode("l").alias("prediction"))
    return grid.join(counts, [*by, "truth", "prediction"], "left").select(*by, "truth", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalised_confusion(matrix: DataFrame) -> DataFrame:
    """Each cell's share of its row, 0 in empty rows."""
    return matrix.withColumn("share", safe_ratio(F.col("n"), F.sum("n").over(W.partitionBy("truth"))))


def counts(y: str = "y", yhat: str = "yhat", positive=1) -> list[Column]:
    t, p = F.col(y) == positive, F.col(yhat) == positive
    return [F.sum((a & b).cast("long")).alias(n) for n, a, b in (("tp", t, p), ("fp", ~t, p), ("fn", t, ~p), ("tn", ~t, ~p))]


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, fpr from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"accuracy": safe_ratio(tp + tn, tp + fp + fn + tn), "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "f1": f1_of(tp, fp, fn), "fpr": safe_ratio(fp, fp + tn)})


def binary_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    return with_rates(df.groupBy(*by).agg(*counts(y, yhat)))


def per_class(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    """label, precision, recall, f1, support of each class."""
    matrix = confusion(df, y, yhat, by)
    rows = matrix.groupBy(*by, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    columns = matrix.groupBy(*by, F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    out = rows.join(columns, [*by, "label"]).withColumns({"precision": safe_ratio(F.col("tp"), F.col("predicted")), "recall": safe_ratio(F.col("tp"), F.col("support"))})
    return out.withColumn("f1", safe_ratio(2 * F.col("tp"), F.col("predicted") + F.col("support"))).select(*by, "label", "precision", "recall", "f1", "support", "tp")


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """A row for each class (its label as text), then accuracy, macro avg and weighted avg."""
    classes = per_class(df, y, yhat)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.cast("long").alias("support"))
    total = F.sum("support")
    accuracy = safe_ratio(F.sum("tp"), total)
    weighted = [safe_ratio(F.sum(F.col(c) * F.col("support")), total) for c in ("precision", "recall", "f1")]
    summary = classes.agg(F.array(row("accuracy", accuracy, accuracy, accuracy, total), row("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1"), total), row("weighted avg", *weighted, total)).alias("rows"))
    each = classes.select(F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    return each.union(summary.select(F.explode("rows").alias("r")).select("r.*"))


def headline_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """accuracy, precision, recall, f1: of class 1 if there are two classes at most, else weighted by support."""
    c = per_class(df, y, yhat)
    few = F.count("*") <= 2
    of = lambda m: F.when(few, F.coalesce(F.max(F.when(F.col("label") == 1, F.col(m))), F.lit(0.0))).otherwise(safe_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")))
    return c.agg(safe_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), of("precision").alias("precision"), of("recall").alias("recall"), of("f1").alias("f1"))


def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: tuple[str, ...] = ()) -> DataFrame:
    """n, mse, rmse, mae and r2 (null if the truth doesn't vary)."""
    e = F.col(y) - F.col(yhat)
    sst = F.count(y) * F.var_pop(y)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"))
    return out.withColumn("rmse", F.sqrt("mse"))


def score_counts(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each distinct score: pos and neg."""
    return df.where(F.col(p).isNotNull()).groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))


def auc(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve by rank sums, ties by halves; null with one class only."""
    runs = running_sums(score_counts(df, y, p, by), "p", {"below": "neg"}, by)
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return runs.groupBy(*by).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def curve(df: DataFrame, y: str = "y", p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """threshold, tp, fp, positives, negatives, precision, recall, f1, fpr of predicting 1 where p >= threshold, for each distinct score."""
    runs = running_sums(score_counts(df, y, p, by), "p", {"tp": "pos", "fp": "neg"}, by, descending=True)
    totals = runs.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    runs = runs.join(totals, list(by)) if by else runs.join(F.broadcast(totals))  # one row of totals
    tp, fp, positives = F.col("tp"), F.col("fp"), F.col("positives")
    return runs.select(*by, F.col("p").alias("threshold"), "tp", "fp", "positives", "negatives").withColumns(
        {"precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, positives), "f1": safe_ratio(2 * tp, tp + fp + positives), "fpr": safe_ratio(fp, F.col("negatives"))}
    )


def f1_threshold(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The point of largest F1, the lowest threshold among equals."""
    best = F.min_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("b")
    return points.groupBy(*by).agg(best).where("b is not null").select(*by, "b.*")


def fpr_threshold(points: DataFrame, limit: float = FPR_LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """The point of largest recall with a false-positive rate up to the limit, the highest threshold among equals; no row if none."""
    best = F.min_by(F.struct("threshold", "precision", "recall", "fpr"), F.struct(-F.col("recall"), -F.col("threshold"))).alias("b")
    return points.where(F.col("fpr") <= limit).groupBy(*by).agg(best).where("b is not null").select(*by, "b.*")


def at_thresholds(df: DataFrame, thresholds: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """Metrics at each threshold.  Rows aren't multiplied: each distinct score counts first."""
    few = score_counts(df, y, p).select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"), "p", "pos", "neg")
    hit = F.col("p") >= F.col("threshold")
    sums = [F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long").alias(a) for a, c, n in (("tp", hit, "pos"), ("fp", hit, "neg"), ("fn", ~hit, "pos"), ("tn", ~hit, "neg"))]
    return with_rates(few.groupBy("threshold").agg(*sums))


def threshold_scan(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """threshold, precision, recall, f1 and whether it's the best F1 (the lowest threshold among equals)."""
    rows = at_thresholds(df, list(SCAN), y, p).select("threshold", "precision", "recall", "f1")
    first = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "threshold"))  # eleven rows
    return rows.withColumn("is_best", first == 1)


def compare_thresholds(df: DataFrame, chosen: dict[str, float], base: str, y: str = "y", p: str = "p") -> DataFrame:
    """name, threshold, metrics, and the differences from the one called `base`."""
    names = F.create_map(*[x for n, t in chosen.items() for x in (F.lit(n), F.lit(float(t)))])
    rows = at_thresholds(df, sorted(set(chosen.values())), y, p)
    rows = rows.select("threshold", "precision", "recall", "f1", "fpr", F.explode(names).alias("name", "own")).where("threshold = own").drop("own")
    whole = W.partitionBy(F.lit(0))  # a row for each name
    return rows.withColumns({f"{m}_delta": F.col(m) - F.max(F.when(F.col("name") == base, F.col(m))).over(whole) for m in ("precision", "recall", "f1", "fpr")})


def misses_by(df: DataFrame, group: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Of true positives by group: n, fn, recall; worst first."""
    out = df.where(F.col(y) == 1).groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(yhat) != 1).cast("long")).alias("fn"))
    return out.withColumn("recall", 1 - F.col("fn") / F.col("n")).orderBy("recall", group)


def false_alarms_by(df: DataFrame, group: str, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Of true negatives by group: n, fp, rate; worst first."""
    out = df.where(F.col(y) != 1).groupBy(group).agg(F.count("*").alias("n"), F.sum((F.col(yhat) == 1).cast("long")).alias("fp"))
    return out.withColumn("rate", F.col("fp") / F.col("n")).orderBy(F.desc("rate"), group)


def errors_at(df: DataFrame, thresholds: dict[str, float], subtype: str, day: str, y: str = "y", p: str = "p") -> DataFrame:
    """point, kind (fn by subtype, fp by day), grp, n, errors, at each operating point, from one pass of counts."""
    few = df.groupBy(F.col(subtype).alias("subtype"), F.col(day).alias("day"), (F.col(y) == 1).alias("positive"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    points = F.array(*[F.struct(F.lit(n).alias("point"), F.lit(float(t)).alias("t")) for n, t in thresholds.items()])
    rows = few.select("*", F.explode(points).alias("o")).select("*", "o.*").withColumn("hit", F.col("p") >= F.col("t"))
    kind, group, wrong = F.when(F.col("positive"), "fn").otherwise("fp"), F.when(F.col("positive"), F.col("subtype")).otherwise(F.col("day")), F.col("hit") != F.col("positive")
    return rows.groupBy("point", kind.alias("kind"), group.alias("grp")).agg(F.sum("n").alias("n"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("errors"))


def pooled_threshold(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """F1-max threshold over all workers' rows, with n_val_samples; no row below 30 rows or with one class."""
    points = curve(df, y, p)
    enough = points.agg(F.max("positives").alias("a"), F.max("negatives").alias("b")).where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") + F.col("b") >= LEAST_ROWS))
    return f1_threshold(points).join(F.broadcast(enough)).select("threshold", "precision", "recall", "f1", (F.col("a") + F.col("b")).alias("n_val_samples"))  # one row each


def worker_thresholds(df: DataFrame, worker: str = "worker", y: str = "y", p: str = "p", least_auc: float = LEAST_AUC) -> DataFrame:
    """Each worker's threshold: its own F1-max one, if it has 30 rows, two classes and an AUC that is high enough; else the pooled one; `own` tells which."""
    points = curve(df, y, p, (worker,))
    sizes = points.groupBy(worker).agg(F.max("positives").alias("a"), F.max("negatives").alias("b"))
    rows = f1_threshold(points, (worker,)).join(sizes, worker).join(auc(df, y, p, (worker,)), worker)
    own = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") + F.col("b") >= LEAST_ROWS) & F.coalesce(F.col("auc") >= least_auc, F.lit(False))
    pooled = pooled_threshold(df, y, p).select(F.col("threshold").alias("pooled"))
    rows = rows.join(F.broadcast(pooled), how="left")  # one row
    return rows.select(worker, own.alias("own"), F.when(own, F.col("threshold")).otherwise(F.col("pooled")).alias("threshold"), (F.col("a") + F.col("b")).alias("n_val_samples"), "auc")


def resolved_thresholds(workers: DataFrame, own: DataFrame, pooled: float | None, manifest: float | None, worker: str = "worker") -> DataFrame:
    """worker, threshold, origin: its own, else the federated, else the manifest's; null (argmax) if there's none."""
    rows = workers.join(own.select(worker, F.col("threshold").alias("t")), worker, "left")
    picks = [F.when(F.col("t").isNotNull(), "worker"), F.lit("federated") if pooled is not None else F.lit(None), F.lit("manifest") if manifest is not None else F.lit(None)]
    return rows.select(worker, F.coalesce("t", F.lit(pooled).cast("double"), F.lit(manifest).cast("double")).alias("threshold"), F.coalesce(*picks, F.lit("argmax")).alias("origin"))


def macro_average(per_worker: DataFrame, metrics: list[str], size: str, least: int = LEAST_ROWS) -> DataFrame:
    """Means over the workers whose `size` (smallest class, or rows) is at least 30; nulls don't count."""
    return per_worker.where(F.col(size) >= least).agg(F.count("*").alias("workers"), *[F.avg(m).alias(m) for m in metrics])


def worker_metrics(df: DataFrame, worker: str = "worker", y: str = "y", yhat: str = "yhat", p: str = "p") -> DataFrame:
    """Binary metrics, AUC and class counts of each worker."""
    rows = binary_metrics(df, y, yhat, (worker,)).withColumns({"positives": F.col("tp") + F.col("fn"), "negatives": F.col("fp") + F.col("tn")})
    return rows.withColumn("smallest", F.least("positives", "negatives")).join(auc(df, y, p, (worker,)), worker, "left")


def spread(trials: DataFrame, by: list[str], metric: str, top: int = 15) -> DataFrame:
    """Mean and population deviation of a metric over trials, the best first."""
    return trials.groupBy(*by).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("deviation")).orderBy(F.desc("mean"), *by).limit(top)


def class_distribution(df: DataFrame, y: str = "y") -> DataFrame:
    """label, n, share, and the imbalance: largest over smallest class."""
    whole = W.partitionBy(F.lit(0))  # a row for each class
    rows = df.groupBy(F.col(y).alias("label")).agg(F.count("*").alias("n"))
    return rows.withColumns({"share": F.col("n") / F.sum("n").over(whole), "imbalance": F.max("n").over(whole) / F.min("n").over(whole)})
