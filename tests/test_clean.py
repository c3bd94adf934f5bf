import math

import pytest

from arborlane.operators import clean

RAW = [("Benign", "1", "2", "4", "1", "3", "10.0.0.1"), ("Bot", "1", "0", "1", "1", "0", "10.0.0.2"), ("Label", "x", "x", "x", "x", "x", "Src IP"), (None, "2", "4", "Infinity", "0", "1", "x"), (" Bot", "bad", "1", "1", "1", "1", "x")]
NAMES = " label |Flow IAT Std|Flow IAT Mean|SYN Flag Cnt|ACK Flag Cnt|Fwd IAT Mean|Src IP".split("|")


@pytest.fixture
def df(spark):
    rows = spark.createDataFrame(RAW, [f"c{i}" for i in range(7)]).toDF(*NAMES)
    rows = clean.rename_target(clean.trim_columns(rows))
    return clean.drop_header_rows(rows).withColumn("Fwd IAT Std", clean.F.lit("1"))


def test_headers_and_null_labels(df):
    assert sorted(str(r.Label) for r in df.collect()) == ["Benign", "Bot", "Bot", "None"]


def test_process(df):
    rows = clean.process(df.withColumn("Label", clean.binarise("Label"))).collect()
    assert len(rows) == 1
    (r,) = rows
    assert r["Label"] == 0 and r["Flow IAT CV"] == 0.5 and math.isclose(r["Fwd IAT CV"], 1 / 3) and r["SYN_ACK_Ratio"] == 2.0
    assert "Src IP" not in r.asDict()


def test_binarise_counts_null_as_positive(df):
    assert sorted(r[0] for r in df.select(clean.binarise("Label")).collect()) == [0, 1, 1, 1]


def test_metadata_by_substring():
    found, odd = clean.metadata_columns(["Airport_Score", "Dst Port", "Label", "Init Fwd Win Byts", "Down/Up Ratio", "Timestamp"])
    assert found == ["Airport_Score", "Dst Port", "Timestamp"] and odd == ["Airport_Score"]


def test_missing_columns_are_named(spark):
    with pytest.raises(KeyError, match="Fwd IAT Std"):
        clean.derive(spark.createDataFrame([(1.0,)], "`Flow IAT Std` double"))


def test_targets(spark):
    assert clean.resolve_target(spark.createDataFrame([(1.0,)], "Target double")) == "Target"
    with pytest.raises(KeyError):
        clean.resolve_target(spark.createDataFrame([(1.0,)], "x double"))
    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, `b.c` double, Label int")
    row = clean.separate(df).first()
    assert row.features.toArray().tolist() == [1.0, 2.0] and row.label == 1.0
    assert clean.project(df, ["a"]).columns == ["a", "Label"] and clean.drop_selected(df, ["a", "gone"]).columns == ["b.c", "Label"]


def test_drop_invalid_drops_every_kind(spark):
    rows = [(1.0, "a"), (float("nan"), "a"), (float("inf"), "a"), (-float("inf"), "a"), (None, "a"), (2.0, None)]
    assert clean.drop_invalid(spark.createDataFrame(rows, "x double, s string")).count() == 1
