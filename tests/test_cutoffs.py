from pyspark.sql import functions as F

from arborlane.functions import cutoffs
from arborlane.functions.hashing import exact_rank
from arborlane.operators import sampling


def table(spark, n=6000):
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, None).otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("day"), (F.col("id") % 3 == 0).cast("int").alias("Label"), F.lit("clash").alias("h"), F.lit("clash").alias("chosen")).repartition(5)


def test_same_rows_as_ranks(spark):
    df = table(spark)
    for by in ((), ("day",), ("day", "Label")):
        for wanted in (lambda size: F.lit(100), lambda size: sampling.half_even(size * 0.37), lambda size: size, lambda size: F.lit(0), lambda size: size + 5):
            want = {r.id for r in exact_rank(df, 7, "id", by, "r_", "s_").where(F.col("r_") <= wanted(F.col("s_"))).select("id").collect()}
            got = cutoffs.first_by_hash(df, 7, "id", by, wanted, "in", "size")
            assert {r.id for r in got.where("in").select("id").collect()} == want and got.count() == 6000
            assert got.columns == [*df.columns, "size", "in"] or set(got.columns) == {*df.columns, "size", "in"}


def test_many_groups_are_ranked_and_give_the_same(spark, monkeypatch):
    df = table(spark, 800)
    one = {r.id for r in sampling.quota_sample(df, "id", "day", 30).collect()}
    monkeypatch.setattr(cutoffs, "MOST_GROUPS", 2)
    assert {r.id for r in sampling.quota_sample(df, "id", "day", 30).collect()} == one


def test_equal_hashes_go_by_key_and_null_keys_come_first(spark, monkeypatch):
    monkeypatch.setattr(cutoffs, "hash32", lambda seed, *keys: F.lit(5).cast("long"))
    df = spark.createDataFrame([(k,) for k in [None, *range(20)]], "id long")
    got = cutoffs.first_by_hash(df, 1, "id", (), lambda size: F.lit(4), "in").where("in").collect()
    assert {r.id for r in got} == {None, 0, 1, 2}
    assert sampling.quota_sample(df.limit(0), "id", "id", 3).count() == 0


def test_no_row_shuffles(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (sampling.stratified_split(df, "id", "Label"), sampling.undersample(df, "id", "Label", 0.5), sampling.quota_sample(df, "id", "day", 100), sampling.fraction_sample(df, "id", "day", 0.3), sampling.validation_carve(df, "id", "Label"), sampling.absolute_sample(df, "id", "Label", 500), sampling.prediction_sample(df, "id", 50), sampling.protected_rebalance(df, "id", "day", ["hot"], F.col("Label") == 0, 900)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Window" not in plan and "SortMergeJoin" not in plan
