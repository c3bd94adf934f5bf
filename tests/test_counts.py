"""CSV records counted by blocks against whole parses."""

import csv
import random

import pytest

from arborlane.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, top = random.Random(2), tmp_path_factory.mktemp("csv")
    for k in range(4):
        (top / f"set {k}").mkdir()
        with open(top / f"set {k}" / "part.csv", "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(["a", "b"])
            for i in range(700):
                out.writerow([i, "".join(rng.choice(["x", ",", '"', "\n", " ", "word"]) for _ in range(rng.randint(0, 12)))])
    (top / "empty").mkdir()
    (top / "empty" / "none.csv").write_text("a,b\n\n\n1,2\n   \n3,\"open\n")
    return top


def parsed(path):
    with open(path, newline="") as f:
        return sum(1 for row in csv.reader(f) if row and (len(row) > 1 or row[0].strip())) - 1


@pytest.mark.parametrize("block", ["128m", "700b"])
def test_counts_equal_a_whole_parse(spark, folder, block):
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        sources = [str(p) for p in sorted(folder.iterdir())]
        got = {r.source.replace("%20", " ").rsplit("/", 2)[1]: r.n for r in files.count_rows(spark, sources).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {p.name: parsed(next(p.glob("*.csv"))) for p in folder.iterdir()}
    whole = spark.read.csv(str(folder / "set 1"), header=True, multiLine=True, escape='"')
    assert got["set 1"] == whole.count()


def test_cached_counts_take_one_job_for_all_lacking(spark, folder, tmp_path):
    sources, calls = [str(p) for p in sorted(folder.iterdir())], []
    real, cache = files.count_rows, str(tmp_path / "counts")
    files.count_rows = lambda s, which: calls.append(which) or real(s, which)
    try:
        first = files.cached_counts(spark, sources[:2], cache)
        found = files.cached_counts(spark, sources, cache)
        assert files.cached_counts(spark, sources, cache) == found
    finally:
        files.count_rows = real
    assert calls == [sources[:2], sources[2:]] and first.items() <= found.items()
    assert found == {str(p): parsed(next(p.glob("*.csv"))) for p in folder.iterdir()}
    with pytest.raises(FileNotFoundError):
        files.cached_counts(spark, [str(tmp_path / "gone")], cache)
