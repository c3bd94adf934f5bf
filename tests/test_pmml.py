from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from arborlane.operators import cart, forest
from arborlane.schemas import Hyperparameters
from arborlane.sources import pmml


@pytest.mark.parametrize("kind", ["classifier", "regressor"])
def test_a_forest_reads_back_as_it_was(spark, tmp_path, kind):
    df = spark.range(300).select("id", (F.col("id") % 17 / 3).alias("a <b>"), F.hash("id").cast("double").alias('c"d'), (F.col("id") % 3).cast("double").alias("y"))
    names, request = ["a <b>", 'c"d'], Hyperparameters(tree_type=kind, target_column="y", max_depth=5, max_features="all")
    nodes = cart.grow(df, request, names, "id", [cart.Tree(3, 1), cart.Tree(8, 2)])
    pmml.write_pmml(nodes, names, "y", str(tmp_path / "m"), kind == "classifier")
    read = pmml.read_pmml(spark, str(tmp_path / "m"), names)
    rows = lambda d: sorted(map(repr, (tuple(r) for r in d.select(*nodes.columns).collect())))
    assert rows(read) == rows(nodes)
    assert sorted(p.name for p in (tmp_path / "m").glob("tree_id=*")) == ["tree_id=3", "tree_id=8"]
    for f in (tmp_path / "m").rglob("*.txt"):
        assert ElementTree.parse(f).getroot().get("version") == "4.4"
    with pytest.raises(Exception, match="asks for"):
        pmml.read_pmml(spark, str(tmp_path / "m"), ["other"]).count()


def test_a_tree_deeper_than_the_stack(tmp_path):
    rows = [{"tree_id": 0, "node_id": 2 * k, "feature": 0, "threshold": k / 3, "left": 2 * k + 1, "right": 2 * k + 2, "support": None, "dist": None} for k in range(3000)]
    rows += [{"tree_id": 0, "node_id": 2 * k + 1, "feature": None, "threshold": None, "left": None, "right": None, "support": 1, "dist": [0.1, 0.9]} for k in range(3000)]
    rows.append({"tree_id": 0, "node_id": 6000, "feature": None, "threshold": None, "left": None, "right": None, "support": 7, "dist": [1 / 3, 2 / 3]})
    back = pmml.nodes_of(pmml.document(0, rows, ["x"], "y", True), ["x"])
    assert sorted(back) == sorted(tuple(r.values()) for r in rows) or {r[1]: r[3] for r in back} == {r["node_id"]: r["threshold"] for r in rows}
