"""Operator 7, document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (a piece between line feeds, empty ones too) hashes to a wide
vector; a document's fingerprint is the sum of its paragraphs' vectors, lane by
lane modulo a power of two.  So it doesn't depend on their order, and
paragraphs can be inserted or deleted by adding or subtracting their vectors
(`add`, `subtract`).

A vector has two parts:

* 8 lanes modulo 2**64 from BLAKE2b of the paragraph: equality.
* 256 lanes modulo 2**16: each run of up to three words of the paragraph adds
  +1 or -1 to one lane.  The inner product of two such sums estimates how many
  runs two texts share (a count sketch, error about 1/16 of the texts' sizes),
  which `likeness` turns into 2ab / (aa + bb), clipped to 0..1.  Lanes wrap, so
  likeness (not equality) loses its meaning if one run occurs over 32767 times.

The next document, in descending doc_id, comes by one shuffle into ranges of
doc_id, each a task; the first row of a range is also sent to the range before
it, so neighbours always meet without any global window.  An id that many rows
share (null is one) is cut into ranges by how its texts begin.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, mix, read, scan_partitions, texts

EXACT, LANES = 8, 256
_NONE = -(2**63)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the paragraphs' vectors: (n, 8) modulo 2**64 and (n, 256) modulo 2**16."""
    if not many:
        return np.zeros((0, EXACT), U64), np.zeros((0, LANES), np.int16)
    encoded = [x.encode("utf-8", "surrogatepass") for x in many]
    digests, first = [], []
    for x in encoded:
        first.append(len(digests))
        digests += [hashlib.blake2b(p).digest() for p in x.split(b"\n")]
    exact = np.add.reduceat(np.frombuffer(b"".join(digests), "<u8").reshape(-1, EXACT), np.array(first), axis=0)
    words = Words(encoded)
    if not len(words.start):
        return exact, np.zeros((len(many), LANES), np.int16)
    line = np.cumsum(words.bytes == 10)[words.start]
    h = words.hash
    run = h.copy()
    for k in (1, 2):
        same = line[k:] == line[:-k] if len(line) > k else np.zeros(0, bool)
        run[: len(same)][same] += h[k:][same] * U64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
    run = mix(run)
    place = words.doc * LANES + (run & U64(LANES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((run >> U64(40)) & U64(1)).astype(np.float64)
    lanes = np.bincount(place, weights=sign, minlength=len(many) * LANES).astype(np.int64).astype(np.int16)
    return exact, lanes.reshape(-1, LANES)


def pack(exact: np.ndarray, lanes: np.ndarray) -> str:
    return base64.b64encode(exact.astype("<u8").tobytes() + lanes.astype("<i2").tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw, "<u8", EXACT), np.frombuffer(raw, "<i2", LANES, 8 * EXACT)


def fingerprint(text: str | None) -> str:
    exact, lanes = vectors([text or ""])
    return pack(exact[0], lanes[0])


def add(one: str, other: str) -> str:
    """The fingerprint of both documents' paragraphs together."""
    (a, b), (c, d) = unpack(one), unpack(other)
    return pack(a + c, b + d)


def subtract(one: str, other: str) -> str:
    """The fingerprint without the other document's paragraphs."""
    (a, b), (c, d) = unpack(one), unpack(other)
    return pack(a - c, b - d)


def likenesses(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    below = (x * x).sum(1) + (y * y).sum(1)
    shared = np.divide(2 * (x * y).sum(1), below, out=np.zeros(len(x)), where=below > 0)
    return np.where((a[0] == b[0]).all(1) & (a[1] == b[1]).all(1), 1.0, np.clip(shared, 0.0, 1.0))


def likeness(one: str, other: str) -> float:
    return float(likenesses(*(tuple(p[None] for p in unpack(x)) for x in (one, other)))[0])


def _prefixes(many: list[str | None]) -> np.ndarray:
    """The first eight UTF-8 bytes of each text as a number: numbers in the texts' order, if not strictly; 0 for null."""
    return np.frombuffer(b"".join((x or "")[:8].encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0") for x in many), ">u8").astype(U64).view(np.int64) ^ np.int64(_NONE)


class Ranges:
    """Ranges of documents in descending doc_id.  An id that fills ranges of its own is cut further, by how its texts begin.

    `bounds` are pairs (~doc_id, prefix) in that order; `heads` gives each range
    that has rows its first key and the range before it (around the end, too).
    """

    def __init__(self, own: DataFrame, n: int):
        quantiles = Counter(int(x) for x in own.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)) if n > 1 else Counter()
        self.hot = {x for x, times in quantiles.items() if times > 1}
        bounds = {(~x, _NONE) for x in quantiles}
        key = self.key(own)
        if self.hot:
            parts = max(quantiles.values()) + 1
            cuts = key.where(F.col("doc_id").isin(*self.hot)).groupBy("doc_id").agg(F.percentile_approx("prefix", [k / parts for k in range(1, parts)], 100 * parts)).collect()
            bounds |= {(~x, cut) for x, found in cuts for cut in found}
            # what follows a hot id begins a range too
            bounds |= {(~x + 1, _NONE) for x in self.hot if x != _NONE}
        self.bounds = sorted(bounds)
        self.first = np.array([k for k, _ in self.bounds], np.int64)
        where = F.arrow_udf(lambda ids, prefix: pa.array(self.of(ids.to_numpy(zero_copy_only=False), prefix.to_numpy(zero_copy_only=False))), "int")
        tops = sorted((part, (top[0], top[1])) for part, top in key.groupBy(where("doc_id", "prefix").alias("part")).agg(F.min(F.struct(F.bitwise_not("doc_id"), "prefix"))).collect())
        self.heads = {part: (top, tops[k - 1][0]) for k, (part, top) in enumerate(tops)}

    def key(self, own: DataFrame) -> DataFrame:
        """doc_id and prefix; texts are read for hot ids only."""
        if not self.hot:
            return own.select("doc_id", F.lit(_NONE).cast("long").alias("prefix"))
        prefix = F.arrow_udf(lambda text: pa.array(_prefixes(text.to_pylist())), "long")
        hot = F.col("doc_id").isin(*self.hot)
        return own.select("doc_id", F.when(hot, prefix(F.when(hot, F.col("text")))).otherwise(F.lit(_NONE)).alias("prefix"))

    def prefixes(self, ids: np.ndarray, many: pa.Array) -> np.ndarray:
        out = np.full(len(ids), _NONE, np.int64)
        at = np.flatnonzero(np.isin(ids, list(self.hot))) if self.hot else []
        if len(at):
            out[at] = _prefixes(many.take(pa.array(at)).to_pylist())
        return out

    def of(self, ids: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.first, ~ids, "right").astype(np.int32)
        for i in np.flatnonzero(prefix != _NONE):
            part[i] = bisect.bisect_right(self.bounds, (~int(ids[i]), int(prefix[i])))
        for i in np.flatnonzero((prefix == _NONE) & np.isin(ids, list(self.hot))) if self.hot else ():
            part[i] = bisect.bisect_right(self.bounds, (~int(ids[i]), _NONE))
        return part


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (part, doc_id, text, copy) of which, in each part sorted as here, the next row holds the next document's text.

    Equal ids follow each other by text, null ids come last.  A part has one
    task; only rows that are equal in id and in how their texts begin (eight
    bytes) can't be parted.  Each task sends one head row of a part at most.
    """
    own = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NONE)))
    ranges = Ranges(own, 2 * scan_partitions(own))
    names = ["part", "doc_id", "text", "copy"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict[int, tuple[int, str]] = {}
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            prefix = ranges.prefixes(ids, b.column(1))
            part = ranges.of(ids, prefix)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), b.column(1), pa.array(np.zeros(len(ids), bool))], names)
            top = np.array([ranges.heads[p][0] for p in part.tolist()], np.int64).reshape(-1, 2)
            for i in np.flatnonzero((top[:, 0] == ~ids) & (top[:, 1] == prefix)).tolist():
                p, text = int(part[i]), b.column(1)[i].as_py()
                if p not in head or text < head[p][1]:
                    head[p] = (int(ids[i]), text)
        for p, (i, text) in head.items():
            yield pa.RecordBatch.from_arrays([pa.array([ranges.heads[p][1]], pa.int32()), pa.array([i], pa.int64()), pa.array([text], b.schema.field(1).type), pa.array([True])], names)

    rows = own.mapInArrow(dealt, "part int, doc_id long, text string, copy boolean")
    tasks = len(ranges.bounds) + 1
    return rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("part", "copy", F.desc("doc_id"), "text"), tasks


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text is the document with its last floor(n/2) code points
    replaced by the first as many (or all) of the next document's, in
    descending doc_id; after the last comes the first.  A null text is empty;
    a null doc_id comes last and stays null; each of repeated rows gives a row;
    a single document is its own next; an empty table gives an empty result.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        own: list[str] = []
        copy: list[bool] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            n = len(own) if last else len(own) - 1
            rows = [i for i in range(n) if not copy[i]]
            if rows:
                edited = [own[i][: len(own[i]) - len(own[i]) // 2] + own[i + 1][: len(own[i]) // 2] for i in rows]
                mine, changed = vectors(own), vectors(edited)
                at = np.array(rows)
                here, there = tuple(x[at] for x in mine), tuple(x[at + 1] for x in mine)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([None if ids[i] == _NONE else ids[i] for i in rows], pa.int64()),
                        "n_chars": pa.array([len(own[i]) for i in rows], pa.int64()),
                        "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited],
                        "fingerprint": [pack(*x) for x in zip(*here, strict=True)],
                        "edited_fingerprint": [pack(*x) for x in zip(*changed, strict=True)],
                        "near_edited": likenesses(here, changed),
                        "near_next": likenesses(here, there),
                    }
                )
            del ids[:n], own[:n], copy[:n]

        size = 0
        for b in batches:
            for i, text, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ids.append(i), own.append(text), copy.append(c)
                size += len(text) + 64
                if size > 1 << 20:
                    yield from flush(False)
                    size = len(own[-1]) if own else 0
        yield from flush(True)

    return with_next(docs, id_col, text_col)[0].mapInArrow(scored, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
