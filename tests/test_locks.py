"""Long logs of locks: the fold reads a log batch by batch and keeps no log in a row."""

import random

import pyarrow as pa
import pytest

from arborlane.queries import control
from arborlane.streaming import state

SCHEMA = "lock_key string, owner string, action string, ttl double, at_s double"


def log(n, keys):
    rng = random.Random(5)
    return [(rng.choice(keys), rng.choice(["a", "b", None]), rng.choice(["acquire", "acquire", "refresh", "release", None]), rng.choice([0.0, 3.0, 40.0, None]), None if k % 997 == 0 else float(k)) for k in range(n)]


def plain(rows):
    """The rules by three-valued logic, an event at a time."""
    either = lambda *x: True if True in x else None if None in x else False
    both = lambda *x: False if False in x else None if None in x else True
    out, now = [], {}
    for key, owner, action, ttl, at in sorted(rows, key=lambda r: (str(r[0]), -1.0 if r[4] is None else r[4], r[1] or "", r[2] or "", -1.0 if r[3] is None else r[3])):
        holder, until = now.get(key, (None, 0.0))
        past = None if at is None or until is None else at >= until
        free, mine = either(holder is None, past), holder == owner
        granted = either(free, mine) if action == "acquire" else both(mine, None if free is None else not free)
        if granted:
            holder, until = (None, 0.0) if action == "release" else (owner, None if at is None or ttl is None else at + ttl)
        now[key] = (holder, until)
        out.append((key, at, owner, action, granted, holder, until))
    return out, now


@pytest.mark.parametrize("keys", [["x"], ["x", "y", None, "z"]])
def test_long_logs_equal_a_plain_fold(spark, keys):
    rows = log(25_000, keys)
    history = state.lock_history(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted(map(repr, (tuple(r) for r in history.collect()))) == sorted(map(repr, plain(rows)[0]))


def test_no_row_holds_a_log(spark):
    history = state.lock_history(spark.createDataFrame(log(10, ["x"]), SCHEMA))
    assert "collect_list" not in history._jdf.queryExecution().toString()
    assert state.lock_history(spark.createDataFrame([], SCHEMA)).collect() == []


def test_owners_after_long_logs(spark):
    rows = log(12_000, ["x", "y"])
    history = state.lock_history(spark.createDataFrame(rows, SCHEMA))
    last = {key: (holder, until) for key, _, _, _, _, holder, until in plain(rows)[0]}
    want = {key: holder if until is not None and until > 12_000.0 else None for key, (holder, until) in last.items()}
    owners = state.lock_owner(history, 12_000.0)
    assert {r.lock_key: r.owner for r in owners.collect()} == want
    assert "collect_list" not in owners._jdf.queryExecution().toString()


def test_orphans_of_long_logs(spark):
    rows = [("x", "a", "acquire", 10.0, float(k)) for k in range(12_000)] + [("y", "a", "acquire", 5.0, float(k)) for k in range(6_000)]
    jobs = spark.createDataFrame([("x", "PROCESSING", 1.0), ("y", "PROCESSING", 1.0), ("z", "PROCESSING", 1.0), ("w", "COMPLETED", 1.0)], "job_id string, status string, at_s double")
    found = state.orphans(jobs, spark.createDataFrame(rows, SCHEMA), 12_000.0)
    assert sorted(r.job_id for r in found.collect()) == ["y", "z"]
    assert "collect_list" not in found._jdf.queryExecution().toString()


def whole(n, keys):
    """A log without nulls in times and leases, but with equal times, leases of no length and releases without a lease."""
    rng = random.Random(7)
    kinds = ["acquire", "acquire", "refresh", "release", "odd", None]
    rows = [(rng.choice(keys), rng.choice(["a", "b", "c", None]), rng.choice(kinds), rng.choice([0.0, 3.0, 40.0, float("inf")]), float(k // 3)) for k in range(n)]
    return [(key, owner, action, None if action == "release" else ttl, at) for key, owner, action, ttl, at in rows]


@pytest.fixture(params=[3, 10_000])
def batch_rows(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("keys", [["x"], ["x", "y", None, "z"], [f"k{k}" for k in range(900)]])
def test_a_row_a_lock_leaves_the_fold(spark, batch_rows, keys):
    rows = whole(3_000, keys) + (log(300, ["p", "q"]) if batch_rows == 3 else [])
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    done, last = plain(rows)
    assert sorted(map(repr, (tuple(r) for r in state.lock_history(events).collect()))) == sorted(map(repr, done))
    assert sorted(map(repr, (tuple(r) for r in state.lock_states(events).collect()))) == sorted(repr((k, *v)) for k, v in last.items())
    owners = state.lock_owners(events, 900.0)
    assert {r.lock_key: r.owner for r in owners.collect()} == {k: holder if until is not None and until > 900.0 else None for k, (holder, until) in last.items()}


def test_logs_without_nulls_follow_links(monkeypatch):
    columns = list(zip(*[(key, at, owner, action, ttl) for key, owner, action, ttl, at in sorted(whole(2_000, ["x"]), key=lambda r: r[4])], strict=True))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.string(), pa.string(), pa.float64()), strict=True)], ["lock_key", "at_s", "owner", "action", "ttl"])
    monkeypatch.setattr(state, "_replay", None)
    assert sum(rows.num_rows for rows, _ in state._fold(iter([batch]))) == 2_000


def test_the_query_of_owners_groups_no_history(spark, sf):
    plan = control.lock_owner(spark, sf)._jdf.queryExecution().toString()
    assert "max_by" not in plan and "MapInArrow" in plan


def test_orphans_need_no_history(spark, batch_rows):
    rows = whole(3_000, [f"j{k}" for k in range(60)])
    jobs = spark.createDataFrame([(f"j{k}", "PROCESSING" if k % 3 else "FAILED", float(k)) for k in range(70)], "job_id string, status string, at_s double")
    found = state.orphans(jobs, spark.createDataFrame(rows, SCHEMA), 1_000.0)
    held = {k for k, (holder, until) in plain(rows)[1].items() if holder is not None and until > 1_000.0}
    assert held and {r.job_id for r in found.collect()} == {f"j{k}" for k in range(70) if k % 3} - held
    assert "granted" not in found._jdf.queryExecution().toString()
