"""Plans stay as they should: pruned scans, pushed filters, no product of tables, rows shuffled once."""

import re

import pytest
from pyspark.sql import functions as F

from arborlane.functions.hashing import exact_rank
from arborlane.operators import forest, metrics
from arborlane.queries import evaluate, forests, prep


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_scans_read_only_what_is_used(spark, sf):
    assert read_schemas(plan(prep.day_distribution(spark, sf))) == [{"ts"}]
    assert all(s <= {"event_id", "event_type"} for s in read_schemas(plan(prep.stratified_split(spark, sf))))


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in plan(df.where("event_type = 'error'").groupBy("user_id").count())


def test_ranking_shuffles_rows_once(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    text = plan(exact_rank(df, 1, "event_id", ("event_type",)).select("event_id", "value", "rank"))
    exchanges = [line for line in text.splitlines() if re.search(r"\bExchange hashpartitioning", line)]
    rows = [line for line in exchanges if "__b" in line]
    assert len(rows) == 2 and "SinglePartition" not in text  # the rows, and one row for each bucket


@pytest.mark.parametrize("query", [evaluate.auc_rank, evaluate.pr_curve, evaluate.per_worker_threshold, forests.soft_vote, forests.best_split_gini, prep.undersample])
def test_no_cartesian_product(spark, sf, query):
    assert "CartesianProduct" not in plan(query(spark, sf))


def test_scoring_does_not_move_rows(spark, sf):
    assert "Exchange" not in plan(forests.forest_score(spark, sf))
    text = plan(forests.soft_vote(spark, sf))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_curves_sum_scores_before_they_sort(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_type") == "error").cast("int").alias("y"), (F.col("value") / 500).alias("p"))
    text = plan(metrics.curve(df))
    assert text.index("Window") < text.index("HashAggregate")  # the aggregate lies below the window


def test_no_window_holds_all_values_of_a_feature(spark, sf):
    text = plan(forest.best_splits(spark.read.parquet(f"{sf}/events.parquet").withColumn("y", F.lit(1)), ["value", "user_id"], "y"))
    assert "SinglePartition" not in text
    by_value = re.findall(r"windowspecdefinition\(([^)]*?), x#\d+ ASC", text)
    assert by_value and all("__p#" in spec and "__g#" in spec for spec in by_value)  # ranges within a feature
