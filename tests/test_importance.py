from pyspark.sql import functions as F

from arborlane.operators import forest, selection
from arborlane.queries import forests


def test_every_feature_is_permuted_on_its_own(spark):
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    rows = selection.permuted(df, 123, "id", ["a", "b"], ["c", "d"], ["a", "b"]).collect()
    assert len(rows) == 3000 and all(sorted(r[c] for r in rows) == sorted(r.a for r in rows) for c in ("c", "d"))
    assert sum(r.c == r.d for r in rows) < 30 and sum(r.c == r.a for r in rows) < 30


def test_importance_judges_all_rows_that_the_bootstrap_left_out(spark):
    """The registered query draws 0.7 of the rows, so half of them are out of a tree's bag, and says so in its SQL."""
    df = spark.range(4000).withColumnRenamed("id", "event_id")
    got = {r.event_id: r.times for r in forest.with_times(df, "event_id", 3, 0.7, 123).collect()}
    weights = {(r.event_id, r.tree_id): r.weight for r in forest.bootstrap_weights(df, "event_id", 3, 0.7, 123).collect()}
    assert weights == {(k, t): n for k, v in got.items() for t, n in enumerate(v)}
    assert 0.45 < sum(v[0] == 0 for v in got.values()) / 4000 < 0.55
    sql = forests.QUERIES["permutation_importance"][1]
    assert "g.weight = 0" in sql and all(f"123-{f}-{s}:" in sql for f in forests.FEATURES for s in "ab")
