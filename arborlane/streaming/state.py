"""Workers, tasks, jobs and locks as append-only events; the present is the latest row of each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the reference, in seconds: heartbeats older than this are dead; leases of leaders and jobs.
HEARTBEAT, LEADER_LEASE, JOB_LEASE = 120.0, 180.0, 300.0
#: Which status may follow which.
FOLLOWS = {"QUEUED": ("PROCESSING", "FAILED"), "PROCESSING": ("COMPLETED", "FAILED", "PROCESSING"), "COMPLETED": (), "FAILED": ("QUEUED",)}


def latest(events: DataFrame, key: str, at: str = "at_s") -> DataFrame:
    """The last event of each key: a partial maximum in each task, so a busy key costs a row a task."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *[c for c in columns if c != at])).alias("e")).select(key, "e.*")


def live_workers(heartbeats: DataFrame, now: float, key: str = "worker_name", at: str = "at_s") -> DataFrame:
    """key, at_s and live: whether the last heartbeat is at most 120 s old."""
    return heartbeats.groupBy(key).agg(F.max(at).alias(at)).withColumn("live", F.lit(now) - F.col(at) <= HEARTBEAT)


def status_counts(tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return latest(tasks, key).groupBy("status").agg(F.count("*").alias("n"))


def all_done(tasks: DataFrame, expected: int, key: str = "task_id") -> DataFrame:
    """done, expected, passed: the barrier of a round."""
    done = latest(tasks, key).agg(F.count_if(F.col("status") == "COMPLETED").alias("done"))
    return done.select("done", F.lit(expected).cast("long").alias("expected"), (F.col("done") >= expected).alias("passed"))


def missing(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def put_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key the table doesn't hold yet."""
    return rows.join(table.select(key), key, "left_anti")


def lookup(table: DataFrame, **equal) -> DataFrame:
    """Rows with these values: a get by key, or a query by an index."""
    condition = F.lit(True)
    for name, value in equal.items():
        condition = condition & (F.col(name) == value)
    return table.where(condition)


def _grants(rows: pa.RecordBatch, run: np.ndarray, holder: str | None, expires: float) -> tuple[pa.Array, pa.Array, pa.Array] | None:
    """granted, holder and expires_at of each row of a batch without a time or lease that is null or NaN; None if it has one.

    run numbers the rows' locks from 0; holder and expires are the first one's
    before.  What a granted event leaves depends on it alone, and so does which
    event is granted next: the owner's next one, if it comes before the lease
    ends, else the first acquire after that end (after a release, the first
    acquire).  These links are found for all rows at once and then followed.
    """
    n, owners, action = len(run), rows.column(2), rows.column(3)
    at, ttl = (rows.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 4))
    acquire, release = (pc.fill_null(pc.equal(action, a), False).to_numpy(zero_copy_only=False) for a in ("acquire", "release"))
    with np.errstate(invalid="ignore"):  # inf - inf
        ends = np.where(release, 0.0, at + ttl)
    if np.isnan(at).any() or np.isnan(ends).any() or expires != expires:
        return None
    owner = pc.fill_null(pc.dictionary_encode(owners).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    here = np.arange(n)
    begins = np.flatnonzero(np.diff(run, prepend=-1))
    stops = np.append(begins[1:], n)
    stop = stops[run]
    acquires = np.append(np.minimum.accumulate(np.where(acquire, here, n)[::-1])[::-1], n)  # the first one from here on
    group = run * (owner.max() + 2) + owner + 1
    order = np.argsort(group, kind="stable")
    pairs = group[order[1:]] == group[order[:-1]]
    own = np.full(n, n)
    own[order[:-1][pairs]] = order[1:][pairs]  # the owner's next one
    times = np.unique(at)
    turn = run * (len(times) + 1) + np.searchsorted(times, at)
    over = np.searchsorted(turn, run * (len(times) + 1) + np.searchsorted(times, ends))  # the lock's first row at the end of the lease
    next_ = np.where(release | (owner < 0), acquires[here + 1], np.where(np.append(at, np.inf)[own] < ends, own, acquires[np.maximum(over, here + 1)]))
    hops, firsts = np.where(next_ < stop, next_, n).tolist(), acquires[begins]
    if holder is not None:
        mine = np.flatnonzero(pc.fill_null(pc.equal(owners, holder), False).to_numpy(zero_copy_only=False)[: stops[0]])
        late = acquires[np.searchsorted(at[: stops[0]], expires)]
        firsts[0] = mine[0] if len(mine) and at[mine[0]] < expires else late
    steps = []
    for i in np.where(firsts < stops, firsts, n).tolist():
        while i < n:
            steps.append(i)
            i = hops[i]
    granted = np.zeros(n, bool)
    granted[steps] = True
    by = np.maximum.accumulate(np.where(granted, here, -1))
    none = by < begins[run]  # nothing granted yet
    by[none] = 0
    kept = none & (run == 0)
    holders = pc.if_else(pa.array(kept), pa.scalar(holder, owners.type), owners.take(pa.array(by, mask=none | release[by])))
    return pa.array(granted), holders, pa.array(np.where(kept, expires, np.where(none, 0.0, ends[by])))


def _replay(rows: pa.RecordBatch, run: np.ndarray, holder: str | None, expires: float | None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The same an event at a time, for rows of any kind: a comparison with a null is null."""
    lock, grants, holders, ends = 0, [], [], []
    for key, at, owner, action, ttl in zip(run.tolist(), *[c.to_pylist() for c in rows.columns[1:]], strict=True):
        if key != lock:
            lock, holder, expires = key, None, 0.0
        mine = holder == owner
        over = True if holder is None else None if at is None or expires is None else at >= expires or at != at  # NaN is the latest time
        if action == "acquire":
            granted = True if over or mine else over
        else:
            granted = False if not mine else None if over is None else not over
        if granted:
            holder, expires = (None, 0.0) if action == "release" else (owner, None if at is None or ttl is None else at + ttl)
        grants.append(granted)
        holders.append(holder)
        ends.append(expires)
    return pa.array(grants, pa.bool_()), pa.array(holders, rows.column(2).type), pa.array(ends, pa.float64())


def _same(a, b) -> bool:
    """Equal keys, a NaN to a NaN too."""
    return a == b or (a != a and b != b)


def _runs(keys: pa.Array) -> np.ndarray:
    """Numbers from 0 of the runs of equal keys."""
    if pa.types.is_nested(keys.type):
        values = keys.to_pylist()
        changed = [not _same(a, b) for a, b in zip(values[1:], values[:-1], strict=True)]
    else:
        changed = np.diff(pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()) != 0
    return np.concatenate([[0], np.cumsum(changed)]).astype(np.int64)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """lock_key, at_s, owner, action, granted, holder, expires_at of rows sorted by lock and turn, with the numbers of a batch's locks."""
    lock, holder, expires = object(), None, 0.0  # no key equals the first lock
    for b in batches:
        if b.num_rows:
            run = _runs(b.column(0))
            if not _same(b.column(0)[0].as_py(), lock):
                holder, expires = None, 0.0
            found = (None if expires is None else _grants(b, run, holder, expires)) or _replay(b, run, holder, expires)
            lock, holder, expires = b.column(0)[-1].as_py(), found[1][-1].as_py(), found[2][-1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *found], [*b.schema.names[:4], "granted", "holder", "expires_at"]), run


def _turns(events: DataFrame) -> DataFrame:
    """Lock events in the order that _fold takes: a lock's in one task, by their turn."""
    rows = events.select("lock_key", F.col("at_s").cast("double").alias("at_s"), "owner", "action", F.col("ttl").cast("double").alias("ttl"))
    return rows.repartition(F.col("lock_key")).sortWithinPartitions("lock_key", "at_s", "owner", "action", "ttl")


def lock_history(events: DataFrame) -> DataFrame:
    """Each lock event (lock_key, owner, action, ttl, at_s) with `granted`, and `holder` and `expires_at` after it.

    acquire succeeds if the lock is free, expired or already the owner's;
    refresh and release succeed only for the owner of a live lock.  Events of a
    lock take their turn by time, then owner: a fold over them, as each outcome
    depends on the one before.  Spark sorts them within a task, which reads them
    batch by batch and keeps one lock's state, so a log of any length costs time
    in proportion and no memory; see _grants for a batch without nulls.  A
    comparison with a null is null, as in SQL.
    """

    def history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _fold(batches):
            yield rows

    kind = events.schema["lock_key"].dataType.simpleString()
    return _turns(events).mapInArrow(history, f"lock_key {kind}, at_s double, owner string, action string, granted boolean, holder string, expires_at double")


def lock_states(events: DataFrame) -> DataFrame:
    """lock_key, holder and expires_at after each lock's last event: the end of its history, of which only this row leaves the task."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for rows, run in _fold(batches):
            rows = rows.select(["lock_key", "holder", "expires_at"])
            if last is not None and not _same(last.column(0)[0].as_py(), rows.column(0)[0].as_py()):
                yield last
            yield rows.take(pa.array(np.flatnonzero(np.diff(run))))
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield last

    kind = events.schema["lock_key"].dataType.simpleString()
    return _turns(events).mapInArrow(ends, f"lock_key {kind}, holder string, expires_at double")


def _owner(holder: str, expires: str, now: float) -> Column:
    return F.when(F.col(expires) > now, F.col(holder)).alias("owner")


def lock_owner(history: DataFrame, now: float) -> DataFrame:
    """lock_key and owner now; null if it's free or expired."""
    last = history.groupBy("lock_key").agg(F.max_by(F.struct("holder", "expires_at"), F.struct("at_s", "owner")).alias("s"))
    return last.select("lock_key", _owner("s.holder", "s.expires_at", now))


def lock_owners(events: DataFrame, now: float) -> DataFrame:
    """The same from lock events, without a history in between."""
    return lock_states(events).select("lock_key", _owner("holder", "expires_at", now))


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status, ignored: the state that a job's events (job_id, status, at_s) come to; steps that can't follow are ignored, repeated ones too."""
    allowed = F.create_map(*[x for s, nxt in FOLLOWS.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in nxt]).cast("array<string>"))])
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("ignored"))

    def after(state: Column, e: Column) -> Column:
        ok = F.when(state["status"].isNull(), e["status"] == "QUEUED").otherwise(F.array_contains(F.coalesce(F.element_at(allowed, state["status"]), F.array().cast("array<string>")), e["status"]))
        return F.struct(F.when(ok, e["status"]).otherwise(state["status"]).alias("status"), (state["ignored"] + F.when(ok, 0).otherwise(1)).alias("ignored"))

    folded = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at_s", "status"))).alias("events"))
    return folded.select("job_id", F.aggregate("events", start, after).alias("s")).select("job_id", "s.*")


def orphans(jobs: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """Jobs in PROCESSING whose lease (lock_key = job_id) is free or expired: to be resumed from their last complete part."""
    held = lock_owners(leases, now).where("owner is not null").select(F.col("lock_key").alias("job_id"))
    return latest(jobs, "job_id").where("status = 'PROCESSING'").join(held, "job_id", "left_anti")


def retries(tasks: DataFrame, most: int = 3) -> DataFrame:
    """task_id, attempts, retry: failed tasks go again up to three times."""
    rows = tasks.groupBy("task_id").agg(F.count_if(F.col("status") == "FAILED").alias("attempts"), F.max_by("status", "at_s").alias("status"))
    return rows.where("status = 'FAILED'").select("task_id", "attempts", (F.col("attempts") <= most).alias("retry"))


def queue_state(messages: DataFrame, receipts: DataFrame, now: float, visibility: float = 180.0) -> DataFrame:
    """The queue's order now: messages (message_id, sent_at) without deletion; those in flight longer than the visibility timeout go to the head.

    receipts: message_id, action (receive, extend, delete), at_s.
    """
    last = receipts.groupBy("message_id").agg(F.max("at_s").alias("seen"), F.bool_or(F.col("action") == "delete").alias("deleted"))
    rows = messages.join(last, "message_id", "left").where(~F.coalesce("deleted", F.lit(False)))
    flying = F.col("seen").isNotNull() & (F.lit(now) - F.col("seen") < visibility)
    return rows.select("message_id", "sent_at", F.when(flying, "in_flight").when(F.col("seen").isNotNull(), "returned").otherwise("waiting").alias("state"))


def job_stream(spark, folder: str, schema: str) -> DataFrame:
    """The job queue as a stream of JSON files."""
    return spark.readStream.schema(schema).json(folder)


def latest_jobs(stream: DataFrame, table: str, checkpoint: str):
    """Writes each batch's last event of each job to a Parquet table; offsets make it exactly once."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, "job_id").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alarm_rates(flows: DataFrame, time: str, y: str, yhat: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """False-positive rate in tumbling windows, for batches and streams; late rows count up to the watermark."""
    rows = flows.where(F.col(y) != 1)
    if rows.isStreaming:
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)  # watermarks need an instant
    counts = rows.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.sum((F.col(yhat) == 1).cast("long")).alias("fp"))
    return counts.select(F.col("w.start").alias("start"), "n", "fp", (F.col("fp") / F.col("n")).alias("rate"))
