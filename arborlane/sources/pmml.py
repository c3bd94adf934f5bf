"""Forests as PMML 4.4, a document a tree, written and read by tasks.

Thresholds and shares are written so that they read back to the same doubles;
a leaf's rows are its record count.  Other readers of PMML take a document as a
tree model; all of a folder are the forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.forest import NODES
from ..operators.packed import COLUMNS

SPACE = "http://www.dmg.org/PMML-4_4"


def document(tree_id: int, rows: list[dict], features: list[str], target: str, classifier: bool) -> str:
    """One tree's document; rows are its nodes, the first in order of node_id is the root."""
    own, out = {r["node_id"]: r for r in rows}, []
    kind = ('categorical', 'string') if classifier else ("continuous", "double")
    out.append(f'<PMML xmlns="{SPACE}" version="4.4"><Header description={quoteattr(f"tree {tree_id}")}/><DataDictionary>')
    out += [f'<DataField name={quoteattr(f)} optype="continuous" dataType="double"/>' for f in features]
    out.append(f'<DataField name={quoteattr(target)} optype="{kind[0]}" dataType="{kind[1]}"/></DataDictionary>')
    out.append(f'<TreeModel modelName="tree-{tree_id}" functionName="{"classification" if classifier else "regression"}" splitCharacteristic="binarySplit"><MiningSchema>')
    out += [f"<MiningField name={quoteattr(f)}/>" for f in features]
    out.append(f'<MiningField name={quoteattr(target)} usageType="target"/></MiningSchema>')
    waiting: list[tuple[int, str] | str] = [(min(own), "<True/>")]
    while waiting:
        at = waiting.pop()
        if isinstance(at, str):
            out.append(at)
            continue
        node, rule = at
        r = own[node]
        if r["feature"] is None:
            dist = r["dist"]
            score = max(range(len(dist)), key=lambda k: (dist[k], -k)) if classifier else repr(dist[0])
            shares = "".join(f'<ScoreDistribution value="{k}" recordCount="{p * (r["support"] or 0)!r}" probability="{p!r}"/>' for k, p in enumerate(dist)) if classifier else ""
            out.append(f'<Node id="{node}" score="{score}" recordCount="{r["support"] or 0}">{rule}{shares}</Node>')
            continue
        field = quoteattr(features[r["feature"]])
        out.append(f'<Node id="{node}">{rule}')
        waiting += ["</Node>", (r["right"], f'<SimplePredicate field={field} operator="greaterThan" value="{r["threshold"]!r}"/>'), (r["left"], f'<SimplePredicate field={field} operator="lessOrEqual" value="{r["threshold"]!r}"/>')]
    out.append("</TreeModel></PMML>")
    return "".join(out)


def nodes_of(text: str, features: list[str]) -> list[tuple]:
    """Rows of a node table from one document; fields that aren't of the features raise ValueError."""
    root, name = ElementTree.fromstring(text), f"{{{SPACE}}}"
    model = root.find(f"{name}TreeModel")
    tree, place, out = int(model.get("modelName").removeprefix("tree-")), {f: i for i, f in enumerate(features)}, []
    classifier = model.get("functionName") == "classification"
    waiting = [model.find(f"{name}Node")]
    while waiting:
        node = waiting.pop()
        inner = node.findall(f"{name}Node")
        if not inner:
            dist = [float(d.get("probability")) for d in node.findall(f"{name}ScoreDistribution")] if classifier else [float(node.get("score"))]
            out.append((tree, int(node.get("id")), None, None, None, None, int(float(node.get("recordCount"))), dist))
            continue
        left, right = sorted(inner, key=lambda n: n.find(f"{name}SimplePredicate").get("operator") != "lessOrEqual")
        rule = left.find(f"{name}SimplePredicate")
        if rule.get("field") not in place:
            raise ValueError(f"the model asks for {rule.get('field')}")
        out.append((tree, int(node.get("id")), place[rule.get("field")], float(rule.get("value")), int(left.get("id")), int(right.get("id")), None, None))
        waiting += inner
    return out


def write_pmml(nodes: DataFrame, features: list[str], target: str, path: str, classifier: bool = True) -> None:
    """A document for each tree, below tree_id=<number>; a task holds one tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0]["tree_id"]], pa.int64()), pa.array([document(rows[0]["tree_id"], rows, features, target, classifier)])], ["tree_id", "value"])

    documents = nodes.select(*COLUMNS).groupBy("tree_id").applyInArrow(run, "tree_id long, value string")
    documents.write.mode("overwrite").partitionBy("tree_id").text(path)


def read_pmml(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """The node table of a folder of documents."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                columns = zip(*nodes_of(text, features), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value")).mapInArrow(run, NODES)
