"""Operator 12, repair of conversations: the cheapest edits that make turns alternate as (s?(ua)+)?.

Every row is kept, given another role, or deleted, and empty turns may be
inserted; blank and repeated rows must go.  A backward pass finds, for each
row and each of four states of the grammar (start, after system, after user,
after assistant), what the rest costs at least.  A forward walk from the start
then takes, among the edits that this cost allows, the ASCII-least, which gives
the ASCII-least cheapest list of edits.  In every state one role alone may be
inserted or given, so the list also fixes the repaired turns.

A conversation is one task's stream of rows and nothing else shuffles.  Of a
conversation over `limits` (ids of those are few, one for as many rows) the
rows go to ranges of (id, turn, role, hash of text) instead and are packed into
chunks of at most `CHUNK` rows; a chunk is a 4 x 4 matrix of least costs
between states, so the cost to go at each chunk's end is a product of small
matrices, and only packed chunks meet again, in order, for the walk.  What is
left to one task is what the result asks for: one list of edits and one digest
of all turns in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, chunked, partitions_by_bytes, read

#: States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted turn, or one given a role, in each state, and that role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: The state after a kept turn of each initial in each state; -1 where it may not stay.
KEPT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
NEVER = (-1, -1, -1, -1)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAR = 1 << 60
#: Faults of a row; the first two force a deletion.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = " \t\n\v\f\r"
#: Rows and bytes beyond which a conversation goes by chunks: 1/SHARE of all rows between the two bounds; rows of a chunk.
LEAST, MOST, SHARE, MOST_BYTES, CHUNK = 1024, 65536, 1024, 64 << 20, 256
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string"
Costs = tuple[int, int, int, int]


def inserted(v: Costs) -> Costs:
    """Costs where any number of turns may be inserted first."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


ACCEPT = inserted((0, FAR, FAR, 0))


def cost_to_go(initials: list[str], faults: list[int], end: Costs = ACCEPT) -> list[Costs]:
    """The least cost from before each row, and from the end, in each state."""
    out = [end]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after = out[-1]
        v = [DELETE + c for c in after]
        if fault not in (BLANK, DUPLICATE):
            more, to = CUT_OFF if fault == TRUNCATED else 0, KEPT.get(initial, NEVER)
            for s in range(4):
                v[s] = min(v[s], more + REROLE + after[NEXT[s]])
                if to[s] >= 0:
                    v[s] = min(v[s], more + after[to[s]])
        out.append(inserted((v[0], v[1], v[2], v[3])))
    out.reverse()
    return out


def walk(initials: list[str], faults: list[int], costs: list[Costs], state: int, last: bool) -> tuple[str, int, list[tuple[int, str | None]]]:
    """(edits, state at the end, turns that stay): the ASCII-least of the cheapest edits.  A turn is (its row or -1, its new role or None).

    Turns are inserted after the last row only where no row follows.
    """
    edits, turns = [], []
    for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        here, after = costs[i], costs[i + 1]
        while True:
            if DELETE + after[state] == here[state]:
                edits.append("D")
                break
            if INSERT + here[NEXT[state]] == here[state]:
                edits.append("I")
                turns.append((-1, ROLE[state]))
                state = NEXT[state]
                continue
            to = KEPT.get(initial, NEVER)[state]
            if to >= 0 and (CUT_OFF if fault == TRUNCATED else 0) + after[to] == here[state]:
                edits.append("K")
                turns.append((i, None))
                state = to
            else:
                edits.append("R")
                turns.append((i, ROLE[state]))
                state = NEXT[state]
            break
    while last and costs[-1][state]:
        edits.append("I")
        turns.append((-1, ROLE[state]))
        state = NEXT[state]
    return "".join(edits), state, turns


def fault_of(text: str, seen: bool) -> int:
    rest = text.strip(SPACE)
    return BLANK if not rest else DUPLICATE if seen else 0 if rest[-1] in ".!?" else TRUNCATED


class Repair:
    """One conversation, chunk after chunk of its rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.digest, self.state, self.written = conv_id, hashlib.sha256(), START, 0
        self.least = self.most = self.before = None
        self.turns = self.illegal = 0
        self.counts, self.cost, self.edits, self.initial = [0, 0, 0, 0], None, [], None

    def add(self, turns: list[int | None], roles: list[str], texts: list[str], faults: list[int], end: Costs = ACCEPT, last: bool = True) -> list[tuple]:
        """Takes the next rows, whose rest costs `end`; the turns that stay, as rows of TURNS."""
        for turn in turns:
            if turn is not None and (self.before is None or turn != self.before):
                self.turns += 1
                self.least, self.most, self.before = turn if self.least is None else self.least, turn, turn
        initials = [r[:1] for r in roles]
        for initial in initials:
            self.illegal += self.initial is not None and self.initial + initial not in LEGAL
            self.initial = initial
        for fault in faults:
            self.counts[fault] += 1
        costs = cost_to_go(initials, faults, end)
        if self.cost is None:
            self.cost = costs[0][START]
        edits, self.state, stay = walk(initials, faults, costs, self.state, last)
        self.edits.append(edits)
        out = []
        for row, role in stay:
            text = texts[row] if row >= 0 else ""
            out.append((self.conv_id, self.written, role or roles[row], text))
            self.digest.update(f"{chr(10) if self.written else ''}{role or roles[row]}:{text}".encode("utf-8", "surrogatepass"))
            self.written += 1
        return out

    def row(self) -> tuple:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.counts[1:], self.illegal, self.cost or 0, "".join(self.edits), self.digest.hexdigest())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column | None) -> DataFrame:
    """conv_id, turn, role and text (null: a space), digest of the text and copies (how often the row stands there; 0: it is gone, but its conversation was)."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    out = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    return out.withColumn("digest", F.sha2("text", 256))


#: Rows of a conversation in order: by turn, nulls first; rows of one turn by role and the hash of their text.
ORDER = ["turn", "role", "digest"]


def _by_rows(rows: DataFrame, turns: bool) -> DataFrame:
    """Whole conversations, each in one task's stream."""
    schema = TURNS if turns else SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        seen: set[tuple[str, str]] = set()
        out: list[tuple] = []
        current: tuple | None = None

        def done() -> None:
            repair = Repair(current[0])
            stay = repair.add(*([list(x) for x in zip(*own, strict=True)] if own else ([], [], [], [])))
            out.extend(stay if turns else [repair.row()])
            own.clear()
            seen.clear()

        for columns in chunked(batches, "conv_id", "turn", "role", "copies", "text"):
            for conv, turn, role, copies, text in zip(*columns, strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        done()
                    current = (conv,)
                for _ in range(copies):
                    own.append((turn, role, text, fault_of(text, (role, text) in seen)))
                    seen.add((role, text))
            if out:
                yield _batch(out, schema)
                out.clear()
        if current is not None:
            done()
        if out:
            yield _batch(out, schema)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return dealt.select("conv_id", "turn", "role", "copies", "text").mapInArrow(run, schema)


def _unpacked(chunk: list[dict]) -> tuple[list, list, list, list]:
    """turns, roles, texts and faults of a chunk's rows, copies and all."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for r in chunk:
        for k in range(r["copies"]):
            for x, value in zip(out, (r["turn"], r["role"], r["text"], fault_of(r["text"], k > 0 or not r["first"])), strict=True):
                x.append(value)
    return out


def _by_chunks(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations of any length, in chunks of rows."""
    schema = TURNS if turns else SCHEMA
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    keys = ["conv_id", *ORDER]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions_by_bytes(rows, 16 << 20), *keys, "tie")
    # A row's number names its range in the upper bits, so CHUNK rows with one quotient lie side by side.
    placed = checkpointed(placed.sortWithinPartitions(*keys, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    firsts = placed.where("copies > 0").groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    marked = placed.join(firsts, "at", "left").withColumn("first", F.coalesce("is_first", F.lit(False)))
    row = F.struct("at", "turn", "role", "text", "copies", "first")
    packed = marked.groupBy("conv", "conv_id", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # CHUNK at most

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, chunk, own in zip(*(b.column(c).to_pylist() for c in ("conv", "chunk", "rows")), strict=True):
                _, roles, _, faults = _unpacked(own)
                initials = [r[:1] for r in roles]
                ends = [inserted(tuple(0 if s == t else FAR for s in range(4))) for t in range(4)]
                flat = [min(c, FAR) for end in ends for c in cost_to_go(initials, faults, end)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([chunk], pa.int64()), pa.array([flat], pa.list_(pa.int64()))], ["conv", "chunk", "least"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks from the last one back."""
        of, end = None, ACCEPT
        for b in batches:
            out = []
            for conv, chunk, least in zip(*(b.column(c).to_pylist() for c in ("conv", "chunk", "least")), strict=True):
                last = of != conv
                of, end = conv, ACCEPT if last else end
                out.append((conv, chunk, list(end), last))
                end = tuple(min(least[4 * t + s] + end[t] for t in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_()), strict=True)], ["conv", "chunk", "end", "last"])

    small = packed.select("conv", "chunk", "rows").mapInArrow(matrices, "conv string, chunk long, least array<long>")
    to_go = small.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInArrow(ends, "conv string, chunk long, end array<long>, last boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = None
        for b in batches:
            for k in range(b.num_rows):  # one chunk of rows at a time
                conv_id, own, end, last = (b.column(c)[k].as_py() for c in ("conv_id", "rows", "end", "last"))
                repair = repair or Repair(conv_id)
                stay = repair.add(*_unpacked(own), tuple(end), last)
                if turns and stay:
                    yield _batch(stay, schema)
                if last:
                    if not turns:
                        yield _batch([repair.row()], schema)
                    repair = None

    joined = packed.join(to_go, ["conv", "chunk"]).repartition("conv").sortWithinPartitions("conv", "chunk")
    return joined.select("conv_id", "rows", "end", "last").mapInArrow(run, schema)


def limits(total: int) -> int:
    """Rows beyond which a conversation goes by chunks."""
    return min(MOST, max(LEAST, total // SHARE))


def repair(rows: DataFrame, turns: bool = False, copies: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row of counts, cost, edits (K, R, D, I) and the digest of the repaired turns for each conversation; with `turns`, the repaired turns.

    `copies` (a column of rows, 0 to any number) repeats a row in its place or
    takes it away.  Null roles and texts are one space; rows of null id are one
    conversation; null turns come first; rows of one turn are ordered by role
    and by the SHA-256 of their text; of repeated rows all but the first are
    duplicates.  A conversation without rows left has zeros, no edits and the
    digest of nothing.  An empty table gives an empty result.
    """
    rows = prepared(rows, conv_col, turn_col, role_col, text_col, copies)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long") * F.greatest("copies", F.lit(1))).alias("bytes"), F.sum("copies").alias("all"))
    total = rows.count()
    large = checkpointed(sizes.where((F.greatest("n", "all") > limits(total)) | (F.col("bytes") > MOST_BYTES)).select(F.col("conv_id").alias("of")))
    if large.isEmpty():
        return _by_rows(rows, turns)
    few = F.broadcast(large)  # an id for each `limits` rows or MOST_BYTES bytes
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    return _by_rows(rows.join(few, same, "left_anti"), turns).unionByName(_by_chunks(rows.join(few, same, "left_semi"), turns))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of `conversations` with every twentieth dropped, emptied, stripped of ends, repeated or called user; and how often each stands there."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), changed.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))
    return out, F.col("times")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, times = damaged(read(spark, sf_dir, "conversations"))
    return repair(rows, copies=times)


def _least(*parts: str) -> str:
    return f"least({', '.join(parts)})"


#: CRC-32 by bits, faults by windows, both passes as recursions over all conversations at once.  States 0 to 3 as above.
SQL = f"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
  drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM named),
  copied AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind,
    unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM copied),
  judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
  sizes AS (SELECT conv_id, count(*) AS n FROM judged GROUP BY conv_id),
  totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
  togo(conv_id, i, v) AS (SELECT conv_id, n, [0::BIGINT, 10, 5, 0] FROM sizes
    UNION ALL SELECT conv_id, i, [least(b[1], 5 + b[3], 10 + b[4]), least(b[2], 5 + b[3], 10 + b[4]), least(b[3], 5 + b[4]), least(b[4], 5 + b[3])] FROM (SELECT conv_id, i - 1 AS i, CASE WHEN fault IN (1, 2) THEN [2 + v[1], 2 + v[2], 2 + v[3], 2 + v[4]] ELSE [
      {_least("2 + v[1]", "more + 1 + v[3]", "CASE initial WHEN 's' THEN more + v[2] WHEN 'u' THEN more + v[3] ELSE 1000000000 END")}, {_least("2 + v[2]", "more + 1 + v[3]", "CASE initial WHEN 'u' THEN more + v[3] ELSE 1000000000 END")},
      {_least("2 + v[3]", "more + 1 + v[4]", "CASE initial WHEN 'a' THEN more + v[4] ELSE 1000000000 END")}, {_least("2 + v[4]", "more + 1 + v[3]", "CASE initial WHEN 'u' THEN more + v[3] ELSE 1000000000 END")}] END AS b
      FROM (SELECT t.conv_id, t.i, t.v, r.fault, r.initial, CASE WHEN r.fault = 3 THEN 5 ELSE 0 END AS more FROM togo t JOIN judged r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.i = r.i))),
  steps AS (SELECT t.conv_id, t.i, t.v AS here, u.v AS after, r.fault, r.initial, r.role, r.text, CASE WHEN r.fault = 3 THEN 5 ELSE 0 END AS more FROM togo t
    LEFT JOIN togo u ON t.conv_id IS NOT DISTINCT FROM u.conv_id AND u.i = t.i + 1 LEFT JOIN judged r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = t.i + 1),
  walk(conv_id, i, s, audit, turns) AS (SELECT conv_id, 0::BIGINT, 0, '', []::VARCHAR[] FROM sizes
    UNION ALL SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE WHEN edit = 'D' THEN s WHEN edit = 'K' AND initial = 's' THEN 1 WHEN edit = 'K' AND initial = 'a' THEN 3 WHEN edit = 'K' THEN 2 WHEN s = 2 THEN 3 ELSE 2 END, audit || edit,
      CASE edit WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text) WHEN 'R' THEN list_append(turns, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || text) ELSE list_append(turns, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END) END
    FROM (SELECT w.*, p.initial, p.role, p.text, CASE WHEN p.after IS NOT NULL AND 2 + p.after[s + 1] = p.here[s + 1] THEN 'D' WHEN 5 + p.here[CASE s WHEN 2 THEN 4 ELSE 3 END] = p.here[s + 1] THEN 'I' WHEN p.after IS NULL THEN NULL
      WHEN (p.initial = 's' AND s = 0 AND p.more + p.after[2] = p.here[s + 1]) OR (p.initial = 'u' AND s <> 2 AND p.more + p.after[3] = p.here[s + 1]) OR (p.initial = 'a' AND s = 2 AND p.more + p.after[4] = p.here[s + 1]) THEN 'K' ELSE 'R' END AS edit
      FROM walk w JOIN steps p ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.i) WHERE edit IS NOT NULL),
  ended AS (SELECT w.* FROM walk w JOIN sizes z ON w.conv_id IS NOT DISTINCT FROM z.conv_id AND w.i = z.n JOIN togo t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i WHERE t.v[w.s + 1] = 0)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f.v[1], 0)::BIGINT AS cost,
  coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
  LEFT JOIN togo f ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = 0"""
