"""What several operators share: text columns, vectorised hashing of words and bytes, checkpoints.

The numpy helpers work on the bytes of many texts at once, so a task pays the
price of a Python call per chunk of texts and not per word.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D], the white space that separates words everywhere in this subpackage.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U64 = np.uint64
#: Texts are handled in chunks of about so many bytes.
CHUNK_BYTES = 2 << 20
#: Gives free heap memory back to the system, where the C library can.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Tasks to which the rows of one key may go in a join.
SALTS = 1024


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long and text string (null: empty), and nothing else."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint")
    return folder


def compacted(df: DataFrame) -> DataFrame:
    """df, of small rows from a scan, checkpointed in a sixteenth of the scan's partitions: fewer, larger files."""
    return checkpointed(df.repartition(max(1, scan_partitions(df) // 16)))


def salted_join(rows: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """rows joined with other (a row for each key); a key's rows go to as many tasks as `by` has hashes among them, `SALTS` at most."""
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    spread = rows.select(key, "__salt").distinct().join(other, key)
    return rows.join(spread, [key, "__salt"]).drop("__salt")


def scan_partitions(df: DataFrame) -> int:
    """How many tasks a scan of df has; it grows with the input."""
    return max(1, df.rdd.getNumPartitions())


def partitions_by_bytes(df: DataFrame, each: int, column: str = "text") -> int:
    """A number of partitions that holds about `each` bytes of the text column apiece."""
    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long") + 64)).first()[0] or 0
    return max(1, math.ceil(total / each))


#: What a Python worker keeps between tasks, by name: one thing at a time, as workers serve all operators in turn.
_kept: dict[tuple, object] = {}


def kept(name: tuple, make):
    """What make() gives, kept in this worker until a task of another kind runs."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def released(batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches; drops what other kinds of tasks kept, and at the end gives freed memory back, which an idle worker would hold."""
    if not keep:
        _kept.clear()
    yield from batches
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunked(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = CHUNK_BYTES, keep: bool = False) -> Iterator[list[list]]:
    """Lists of the named columns, the last of which is the text, in chunks of about `limit` characters."""
    for batch in released(batches, keep):
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        start = size = 0
        for i, text in enumerate(lists[-1]):
            size += len(text) + 8
            if size >= limit:
                yield [x[start : i + 1] for x in lists]
                start, size = i + 1, 0
        if start < len(lists[-1]):
            yield [x[start:] for x in lists]


def pieces(many: list[str], limit: int = CHUNK_BYTES // 2) -> Iterator[slice]:
    """Slices of a list of texts, each of about `limit` characters; one at least."""
    start = size = 0
    for i, text in enumerate(many):
        size += len(text) + 8
        if size >= limit:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(many) or not many:
        yield slice(start, len(many))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 16), base, dtype=U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Words:
    """The words of many texts: start, end (byte offsets), doc (index of the text) and hash (64 bits)."""

    def __init__(self, encoded: list[bytes], separator: bytes = b"\n"):
        self.bytes = np.frombuffer(separator.join(encoded) + separator, np.uint8)
        sizes = np.array([len(x) for x in encoded], np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(encoded) else np.zeros(0, np.int64)
        self.n_docs = len(encoded)
        space = _SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    @property
    def hash(self) -> np.ndarray:
        power, inverse = _grown(len(self.bytes) + 1)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(_TABLE[self.bytes] * power[: len(self.bytes)], dtype=U64)])
        return mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U64))


def grams(encoded: list[bytes], n: int, pad: int = 0xFF) -> tuple[np.ndarray, np.ndarray]:
    """Byte n-grams (n up to 8) as integers that end at each byte and at one end mark of each text, and where each text's run starts.

    0xFF never occurs in UTF-8: it stands before the text and once after it.
    """
    gap = bytes([pad]) * (n - 1) or b""
    tail = bytes([pad])
    joined = np.frombuffer(b"".join(gap + x + tail for x in encoded), np.uint8).astype(U64)
    sizes = np.array([len(x) + 1 for x in encoded], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    keys = joined.copy()
    for k in range(1, n):
        keys[k:] |= joined[:-k] << U64(8 * k)
    keep = np.repeat(np.arange(len(encoded), dtype=np.int64) + 1, sizes) * (n - 1) + np.arange(int(sizes.sum()))
    return keys[keep], start


def sum_by(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at start; runs are never empty."""
    return np.add.reduceat(values, start) if len(start) else np.zeros(0, values.dtype)
