"""Every registered query of this half against its SQL in DuckDB, values exactly."""

import duckdb
import pytest

from arborlane.queries import control, evaluate, forests, io, prep

QUERIES = prep.QUERIES | evaluate.QUERIES | forests.QUERIES | control.QUERIES | io.QUERIES
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_equals_sql(spark, sf, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, sf)
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() > 0
