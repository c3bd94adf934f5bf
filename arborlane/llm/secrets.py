"""Operator 1, secret scans: corpus-wide ownership frequency.

Patterns find spans in whole texts; beside them, long mixed tokens of high
entropy are candidates too.  Each candidate's value is hashed, and a hash's
distinct repositories and owners are counted over the whole corpus.  A value
that several owners hold, or very many repositories of one, is a widely copied
example; one that few of both hold looks live.  Candidates beyond the patterns
become spans (kind `owned`) only if they look live.

Only hashes, offsets and ids shuffle, never texts.  A value's holders are made
distinct by value and holder first and counted then, each task adding up its
own, so a value that a third of all rows hold costs a row a task; the join that
brings the verdicts back deals one value's rows to many tasks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, compacted, read, salted_join, unused

#: The base kinds in their order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "owned")
ASSIGN_LEAST = 6
_WORDS = ("passw", "secret", "token", "api")
#: Further candidates: tokens of so many characters with so many digits and letters and so many bits a character.
TOKEN = re.compile(r"(?<![A-Za-z0-9_+=/.-])[A-Za-z0-9_+=/.-]{20,}")
TOKEN_LEAST, TOKEN_DIGITS, TOKEN_LETTERS, TOKEN_BITS = 20, 3, 3, 3.2
#: Parts between the slashes and dots of a path, a host or a version: words, and numbers.
_NAME = re.compile(r"[A-Za-z]?[a-z]{2,}|[A-Z]{3,}|[0-9]+|.?")
_PART = re.compile(r"[^/.]+")
#: From so many owners, or so many repositories, on a value is a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 100
REPLACEMENT = "<secret>"
_NONE = -(2**63)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))
_SPANS_DDL = "array<struct<start:long,kind:int,end:long,value:long>>"


def _bits(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def _value(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the patterns' matches, by start and kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _mixed(token: str) -> bool:
    digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
    return len(token) >= TOKEN_LEAST and digits >= TOKEN_DIGITS and letters >= TOKEN_LETTERS and _bits(token) >= TOKEN_BITS


def _tokens(run: str) -> list[tuple[int, int]]:
    """Where the tokens of a run lie: all of it, or its parts between slashes and dots if one of those is like a name, as in paths and hosts."""
    parts = [m.span() for m in _PART.finditer(run)]
    whole = len(parts) == 1 or (parts[0][0] == 0 and not any(_NAME.fullmatch(run[a:b]) for a, b in parts))
    return [(0, parts[-1][1])] if parts and whole else parts


def further_candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed tokens of high entropy that touch no base span."""
    out = []
    for m in TOKEN.finditer(text):
        for a, b in _tokens(m[0]):
            start, end = m.start() + a, m.start() + b
            if _mixed(m[0][a:b]) and all(end <= s or start >= e for s, _, e, _ in base):
                out.append((start, 3, end, m[0][a:b]))
    return out


def render(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None) -> DataFrame:
    """A row for each document: doc_id, hash (of the text), repo, owner, base and further spans with their values' hashes, base_sha256.

    Without a repository column a document stands for its own repository;
    without an owner column, or where it is null, the repository owns it.
    """
    repo = F.coalesce(F.col(f"`{repo_col or id_col}`").cast("string"), F.lit(""))
    owner = F.coalesce(F.col(f"`{owner_col}`").cast("string"), repo) if owner_col else repo
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NONE)).alias("doc_id"), F.xxhash64(text).alias("hash"), repo.alias("repo"), owner.alias("owner"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, repos, owners, many in chunked(batches, "doc_id", "hash", "repo", "owner", "text"):
            base = [base_spans(x) for x in many]
            more = [further_candidates(x, b) for x, b in zip(many, base, strict=True)]
            rows = [[{"start": s, "kind": k, "end": e, "value": _value(v)} for s, k, e, v in x] for x in base]
            others = [[{"start": s, "kind": k, "end": e, "value": _value(v)} for s, k, e, v in x] for x in more]
            columns = [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(repos, pa.string()), pa.array(owners, pa.string()), pa.array(rows, _SPANS), pa.array(others, _SPANS)]
            columns.append(pa.array([hashlib.sha256(render(x).encode()).hexdigest() for x in base], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "repo", "owner", "base", "more", "base_sha256"])

    return own.mapInArrow(run, f"doc_id long, hash long, repo string, owner string, base {_SPANS_DDL}, more {_SPANS_DDL}, base_sha256 string")


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, owners: how many distinct ones hold each candidate value."""
    held = found.select("repo", "owner", F.explode(F.concat("base", "more")).alias("s"))
    named = F.explode(F.array(F.struct(F.lit(False).alias("owns"), F.col("repo").alias("name")), F.struct(F.lit(True).alias("owns"), F.col("owner").alias("name")))).alias("by")
    one = held.select(F.col("s.value").alias("value"), named).select("value", "by.owns", "by.name").distinct()
    return one.groupBy("value").agg(F.count_if(~F.col("owns")).alias("repositories"), F.count_if(F.col("owns")).alias("owners"))


def judged(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """doc_id, hash and judged (spans with repositories, owners and `live`) of the documents that hold candidates; a row for each distinct (doc_id, hash)."""
    one = found.where(F.size("base") + F.size("more") > 0).dropDuplicates(["doc_id", "hash"])
    each = one.select("doc_id", "hash", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "hash", "s", F.col("s.value").alias("value"))
    live = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), live.alias("live"), "repositories", "owners")
    return salted_join(each, ownership(found), "value", "doc_id").groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list(span)).alias("judged"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """Spans and ownership verdicts of every row.

    doc_id, n_assign, n_access, n_hex, base_sha256, spans (base ones and live
    further ones, as kind:start:end), n_added, n_live and n_copied (spans whose
    value looks live, or is widely copied), most_repositories and most_owners
    (of a value that the text holds; 0 without one).  A null text is empty,
    repeated rows each give a row and count as one repository, an empty table
    gives an empty result.
    """
    found = compacted(candidates(docs, id_col, text_col, owner_col, repo_col))
    kind = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    rows = found.join(judged(found, copied_owners, copied_repositories), ["doc_id", "hash"], "left").withColumn("judged", F.coalesce("judged", F.expr("array()")))
    shown = F.filter("judged", lambda s: (s.kind < 3) | s.live)
    names = F.array(*[F.lit(k) for k in KINDS])
    most = lambda of: F.coalesce(F.array_max(F.transform("judged", of)), F.lit(0)).cast("long")
    return rows.select(
        F.when(F.col("doc_id") != _NONE, F.col("doc_id")).alias("doc_id"),
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        "base_sha256",
        F.array_join(F.transform(shown, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",").alias("spans"),
        F.size(F.filter("judged", lambda s: (s.kind == 3) & s.live)).cast("long").alias("n_added"),
        F.size(F.filter("judged", lambda s: s.live)).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s.live)).cast("long").alias("n_copied"),
        most(lambda s: s.repositories).alias("most_repositories"),
        most(lambda s: s.owners).alias("most_owners"),
    )


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], REPLACEMENT]
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """The same documents with the spans of live-looking secrets masked in `text`, and n_chars (if there) in step.

    Widely copied examples stay.  Texts without candidates never shuffle.  Null
    texts stay null; every row stays, repeated ones too; an empty table stays
    empty.
    """
    key, hashed, live = unused(docs, "id", "hash", "live")
    found = compacted(candidates(docs, owner_col="source" if "source" in docs.columns else None).where(F.size("base") + F.size("more") > 0))
    own = judged(found, copied_owners, copied_repositories)
    spans = own.select(F.col("doc_id").alias(key), F.col("hash").alias(hashed), F.filter("judged", lambda s: s.live).alias(live)).where(F.size(live) > 0)

    @F.arrow_udf("boolean")
    def holds(text: pa.Array) -> pa.Array:
        return pa.array([x is not None and bool((b := base_spans(x)) or further_candidates(x, b)) for x in text.to_pylist()], pa.bool_())

    @F.arrow_udf("string")
    def mask(text: pa.Array, live: pa.Array) -> pa.Array:
        return pa.array([x if s is None else _masked(x, [(y["start"], y["end"]) for y in s]) for x, s in zip(text.to_pylist(), live.to_pylist(), strict=True)], pa.string())

    some = docs.where(holds("text")).withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)), hashed: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    some = some.join(spans, [key, hashed], "left").withColumn("text", mask("text", live))
    if "n_chars" in docs.columns:
        some = some.withColumn("n_chars", F.when(F.col(live).isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~F.coalesce(holds("text"), F.lit(False))).unionByName(some.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
