import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlane.llm import infill
from arborlane.llm.registry import ORACLES

from .cases import CLASHES, EDGE, SCHEMA, edge, empty

MORE = [
    (20, "a\n\n\nb\r\nc", "en", "a"),
    (21, "\n", "en", "a"),
    (22, "has <P> a mark\nline", "en", "a"),
    (23, "half a mark <\n<S\n<M", "en", "a"),
    (24, "é日😀\n" * 70000, "en", "a"),  # over 65,536 code points
    (25, "é日😀\n" * 70000, "en", "a"),
    *[(k, "copy\nof a\ntext\n", "en", "a") for k in range(100, 140)],
    *[(None, "copy\nof a\ntext\n", "en", "a") for _ in range(3)],
]


def expected(doc_id, text):
    """By the words of the contract, with one regular expression and slices."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, d = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, rest = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{rest}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{rest}<M>{middle}"


def check(docs, rows):
    done = infill.restored(infill.cut(docs), "back")
    got = sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in done.collect())
    assert got == sorted(repr(expected(*r[:2])) for r in rows)
    assert sorted(map(str, (r.back for r in done.select("back").collect()))) == sorted(r[1] or "" for r in rows)


def test_edge_rows(spark):
    more = spark.createDataFrame(MORE, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    clashes = {c: F.lit("clash") for c in ("digest", "list", "copies", "kept", "n", "form", "output", "h1", "drawn", "ids")}
    check(edge(spark).unionByName(more).drop(*clashes).withColumns(clashes), EDGE + MORE)
    assert infill.cut(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano_selects_like_a_list(seed):
    rng = random.Random(seed)
    universe = rng.choice([1, 7, 500, 100_000, 3_000_000_000])
    n = rng.randint(1, min(universe, 3000))
    ends = np.array(sorted(rng.sample(range(1, universe + 1), n)), np.int64)
    data = infill.EliasFano.encode(ends, universe)
    own = infill.EliasFano(data)
    assert own.n == n and [own.select(k) for k in range(n + 1)] == [0, *ends.tolist()]
    assert len(data) <= infill.EliasFano.HEAD + 3 + n * (3 + np.log2(universe / n)) / 8
    assert infill.EliasFano(infill.EliasFano.encode(np.zeros(0, np.int64), 0)).n == 0


def test_hot_contents_are_split_and_others_meet(spark):
    rows = [(k, "hot\ntext") for k in range(3000)] + [(5000 + k, f"own\n{k // 2}\n") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lists = infill.index(infill.dealt(docs))
    groups = lists.groupBy("digest").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()
    assert sorted(g.copies for g in groups) == [2] * 3000 + [3000]
    assert all(g.n == 1 for g in groups if g.copies == 2) and max(g.n for g in groups) > 500
    check(docs, rows)


def test_a_text_unlike_its_group_gets_a_list_of_its_own(spark, monkeypatch):
    """If two contents ever had one digest, each would still be cut by its own lines."""
    real = infill.dealt
    monkeypatch.setattr(infill, "dealt", lambda docs: real(docs).withColumn("digest", F.expr("X'00'")).withColumn("salt", F.lit(0)))
    rows = [(k, f"line\n{'x' * k}\nlast {k}\n" * (k % 4)) for k in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_rates(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\n"), "id").alias("text"))
    forms = {r.form: r["count"] for r in infill.cut(docs, 3, 60, 25).groupBy("form").count().collect()}
    assert 700 < forms["plain"] < 900 and 240 < forms["spm"] < 360 and forms["psm"] > 2 * forms["spm"]


def test_query_equals_sql_and_shuffles_texts_once(spark, sf):
    df = infill.query(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLES["op11_distinct_text_infill"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and "ShuffledHashJoin" in final


def test_texts_shuffle_once_without_hot_contents_too(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\n"), "id").alias("text"))
    df = infill.cut(docs)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("Exchange hashpartitioning") == 3  # the texts', again as reused, the index's
