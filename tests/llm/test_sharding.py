from collections import Counter

import pytest

from arborlane.llm import sharding

from .cases import edge, empty

NAMES = [f"s{k}" for k in range(7)]


def test_table_is_even_and_moves_little():
    table = sharding.lookup_table(NAMES, 1009)
    counts = Counter(table)
    assert len(table) == 1009 and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(NAMES[:-1], 1009)
    kept = sum(a == b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert kept > 0.7 * sum(a != 6 for a in table)


def test_first_claims_follow_preferences():
    import hashlib

    order = []
    for n in NAMES:
        d = hashlib.sha256(n.encode()).digest()
        a, b = int.from_bytes(d[:8], "big") % 11, int.from_bytes(d[8:16], "big") % 10 + 1
        order.append([(a + i * b) % 11 for i in range(11)])
    want, turn = {}, 0
    while len(want) < 11:
        slot = next(s for s in order[turn % 7] if s not in want)
        want[slot], turn = turn % 7, turn + 1
    assert sharding.lookup_table(NAMES, 11) == [want[s] for s in range(11)]


@pytest.mark.parametrize("names,size", [(NAMES, 10), ([], 11), (["a", "a"], 11), (NAMES, 5)])
def test_refuses(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_edge_rows(spark):
    rows = sharding.place(edge(spark), NAMES, size=101).collect()
    assert len(rows) == 10 and len({(r.slot, r.shard) for r in rows if r.doc_id == 4}) == 1
    table = sharding.lookup_table(NAMES, 101)
    assert all(r.shard == NAMES[table[r.slot]] for r in rows)
    assert sharding.place(empty(spark), NAMES).count() == 0


def test_query(spark, sf):
    df = sharding.query(spark, sf)
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert "Broadcast" in df._jdf.queryExecution().toString()
