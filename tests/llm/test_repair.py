import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlane.llm import repair
from arborlane.llm.registry import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?$")


def brute(rows):
    """Of (role, text) rows: (cost, edits, turns), the least (cost, edits) over all lists of edits; roles are tried against the grammar's prefixes."""
    seen, faults = set(), []
    for role, text in rows:
        core = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = lambda word: any(GRAMMAR.match(word + tail) for tail in ("", "a", "ua"))

    @functools.cache
    def best(i, word, inserted):
        out = [(0, "", ())] if i == len(rows) and GRAMMAR.match(word) else []
        short = word if len(word) < 4 else word[0] * (word[0] == "s") + word[-2:] if word[-1] == "a" else word[0] * (word[0] == "s") + word[-3:]

        def then(cost, edit, to, turn, at, n):
            if fits(to):
                rest = best(at, to, n)
                out.extend([(cost + rest[0], edit + rest[1], turn + rest[2])] if rest else [])

        for role in ("user", "assistant") if inserted < 2 else ():
            then(5, "I", short + role[0], (f"{role}:",), i, inserted + 1)
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            then(2, "D", short, (), i + 1, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in tuple("sua"):
                    then(more, "K", short + role[0], (f"{role}:{text}",), i + 1, 0)
                for new in ("user", "assistant"):
                    then(more + 1, "R", short + new[0], (f"{new}:{text}",), i + 1, 0)
        return min(out) if out else None

    cost, edits, turns = best(0, "", 0)
    return cost, edits, turns, faults


def expected(table, copies=lambda r: 1):
    out = []
    for conv in {r[0] for r in table}:
        order = lambda r: (r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], hashlib.sha256((" " if r[3] is None else r[3]).encode()).hexdigest())
        own = [r for r in sorted((r for r in table if r[0] == conv), key=order) for _ in range(copies(r))]
        rows = [tuple(" " if x is None else x for x in r[2:]) for r in own]
        cost, edits, turns, faults = brute(rows)
        at = {r[1] for r in own} - {None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        gaps = max(at) - min(at) + 1 - len(at) if at else 0
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(turns).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


EDGE = [
    (1, None, None, None), (1, 3, "", "x."), (1, 3, "", "x."), (1, 5, "tool", "y!"), (None, 1, "user", "no id."), (None, 1, "assistant", "no id."), (None, 1, "user", "no id."),
    (2, 1, "System", "upper."), (2, 2, "sys", "a."), (2, 9, "assistant", "b"), (3, None, "user", "\n\t"), (4, -4, "user", "line.\n"), (4, -1, "assistant", "日本?!"),
    (5, 1, "user", "long " * 40000 + "."), (5, 2, "assistant", "short."), (6, 1, "system", "alone."), (7, 1, "assistant", "a."), (7, 2, "assistant", "b."), (7, 2, "user", "u."),
]


def edge(spark):
    names = ["copies", "digest", "of", "n", "bytes", "first", "chunk", "end", "last", "conv", "at", "times", "audit", "cost", "rows", "tie", "all", "is_first"]
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("clash") for c in names}).repartition(3)


def random_table(seed, conversations=40):
    rng = random.Random(seed)
    words = ["a.", "b!", "c", " ", "d?\n", "e.", ""]
    return [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.choice(words)) for c in range(conversations) for t in rng.sample(range(12), rng.randint(0, 7))]


@pytest.mark.parametrize("chunks", [False, True])
def test_edge_rows_and_random_conversations(spark, monkeypatch, chunks):
    if chunks:
        monkeypatch.setattr(repair, "limits", lambda total: 2)
        monkeypatch.setattr(repair, "CHUNK", 2)
    assert got(repair.repair(edge(spark))) == expected(EDGE)
    table = random_table(1)
    assert got(repair.repair(spark.createDataFrame(table, SCHEMA).repartition(5))) == expected(table)
    assert repair.repair(edge(spark).limit(0)).count() == 0


def test_copies_repeat_and_remove_rows(spark, monkeypatch):
    table = [(c, t, r, f"{c}-{t}.") for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user"])]
    times = lambda r: (r[0] + r[1]) % 3 if r[0] else 0
    df = spark.createDataFrame(table, SCHEMA)
    copies = F.when(F.col("conv_id") == 0, 0).otherwise((F.col("conv_id") + F.col("turn")) % 3)
    rows = got(repair.repair(df, copies=copies))
    assert rows == expected(table, times)
    assert repr((0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) in rows
    monkeypatch.setattr(repair, "limits", lambda total: 1)
    assert got(repair.repair(df, copies=copies)) == rows


def test_a_conversation_with_most_rows_goes_by_chunks_and_others_do_not(spark):
    rng = random.Random(5)
    table = [(0, t, rng.choice(["user", "assistant", "user", "tool"]), f"{rng.randint(0, 900)}{rng.choice('.!x')}") for t in range(3000)] + random_table(2)
    df = spark.createDataFrame(table, SCHEMA).repartition(8)
    by_rows = repair._by_rows(repair.prepared(df, "conv_id", "turn", "role", "text", None), False)
    result = repair.repair(df)
    assert got(result) == got(by_rows)
    assert "Scan ExistingRDD" in result._jdf.queryExecution().toString()  # the checkpointed ranges


def test_turns_come_out_repaired(spark):
    table = random_table(3)
    df = spark.createDataFrame(table, SCHEMA)
    turns = {}
    for r in sorted(repair.repair(df, turns=True).collect(), key=lambda r: (r.conv_id, r.position)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for row in repair.repair(df).collect():
        own = turns.get(row.conv_id, [])
        assert GRAMMAR.match("".join(role[0] for role, _ in own))
        assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest()


def test_damage_by_the_contract(spark):
    table = [(c, t, "assistant", "a. b! c?") for c in range(40) for t in range(10)] + [(None, None, None, None)]
    df, times = repair.damaged(spark.createDataFrame(table, SCHEMA))
    seen = {(r.conv_id, r.turn): r for r in df.collect()}
    for c, t, role, text in table:
        kind, r = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20, seen[c, t]
        role, text = role or " ", text or " "
        assert (r.role, r.text, r.times) == ("user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), {0: 0, 3: 2}.get(kind, 1))


def test_query_equals_sql_and_brute_force(spark, sf):
    rows = got(repair.query(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(repr(tuple(r)) for r in con.execute(ORACLES["op12_grammar_repair"]).fetchall()) == rows
    df, _ = repair.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    times = {(r.conv_id, r.turn): r.times for r in df.collect()}
    assert expected([tuple(r)[:4] for r in df.collect()], lambda r: times[r[0], r[1]]) == rows
