"""Operator 11, fill-in-the-middle: documents cut at line ends that a seed chooses, by an index of distinct texts.

* `dealt` sends each text once, to a task by the SHA-256 of its content, so
  identical texts meet.  A content that fills more than 1/`SHARE` of all bytes
  (at most `SHARE` contents do, so their list is bounded) is dealt on by id.
* `index` groups rows by that hash, keeps one text of each group and computes
  its line ends once, as an Elias-Fano list: each end's low bits as they are,
  its high bits as gaps in unary, 2 + log2(characters / lines) bits a line.
* `cut` joins the lists back to the rows.  A row uses its group's list only if
  its text equals the group's kept text, byte for byte; if it ever doesn't, the
  row gets a list of its own.  A group of one row needs no comparison, so only
  texts that have copies travel a second time.
* The seed and the document's id choose two boundaries by number, and the list
  answers where they are, without another look at the lines.

The index is read where the texts lie: the join sends lists, not documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, read, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The registered query's seed and rates (of 100): documents cut, and of those in suffix-prefix-middle order.
SEED, CUT_RATE, SPM_RATE = 7, 100, 50
#: A content of more than this part of all bytes goes to tasks by id as well; to so many at most.
SHARE, SALTS = 256, 1024
#: Bytes of text for each task that texts are dealt to.
EACH = 32 << 20


class EliasFano:
    """Ascending numbers from 1 to u in few bits; `select` finds the k-th without unpacking the rest."""

    HEAD = 16

    @staticmethod
    def encode(ends: np.ndarray, universe: int) -> bytes:
        """How many numbers (8 bytes), universe (8 bytes), low bits of all, high bits in unary."""
        n = len(ends)
        low = EliasFano.low_bits(n, universe)
        ends = ends.astype(np.int64)
        bits = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        unary = np.zeros(n + (universe >> low) + 1 if n else 0, np.uint8)
        if n:
            unary[(ends >> low) + np.arange(n)] = 1
        return np.array([n, universe], "<i8").tobytes() + np.packbits(bits, bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        return max(0, (universe // n).bit_length() - 1) if n else 0

    def __init__(self, data: bytes):
        self.n, self.universe = (int(x) for x in np.frombuffer(data, "<i8", 2))
        self.low = self.low_bits(self.n, self.universe)
        size = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, size, self.HEAD)
        self.unary = np.frombuffer(data, np.uint8, offset=self.HEAD + size)
        self.ones = np.cumsum(np.bitwise_count(self.unary), dtype=np.int64)

    def select(self, k: int) -> int:
        """The k-th number, from 1; 0 for k = 0."""
        if k == 0:
            return 0
        byte = int(np.searchsorted(self.ones, k))
        before = int(self.ones[byte - 1]) if byte else 0
        bit = int(np.flatnonzero(np.unpackbits(self.unary[byte : byte + 1], bitorder="little"))[k - before - 1])
        high = byte * 8 + bit - (k - 1)
        at = (k - 1) * self.low
        word = int.from_bytes(self.lows[at // 8 : (at + self.low + 7) // 8 + 1].tobytes(), "little") >> (at % 8)
        return (high << self.low) | (word & ((1 << self.low) - 1))


def line_ends(text: str) -> np.ndarray:
    """Code points from the text's start to the end of each of its lines, line feed included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or (len(ends) and ends[-1] == len(points)) else np.append(ends, len(points))


def boundaries(text: str) -> bytes:
    return EliasFano.encode(line_ends(text), len(text))


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, digest and salt, with equal texts in one task; a content of a large share of all bytes in several."""
    # never null, and known as such: a join's own filter of nulls on one side would keep Spark from using one shuffle for both
    rows = docs.withColumn("digest", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))
    sizes = rows.select("digest", (F.octet_length("text").cast("long") + 64).alias("size")).groupBy("digest").agg(F.sum("size").alias("size"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    heavy = [r[0] for r in sizes.where(F.col("size") > max(total // SHARE, 1)).select("digest").collect()]  # fewer than SHARE
    # without heavy contents too an expression and no literal, which Spark would drop from the keys of the group and the join but not of the shuffle
    salt = F.when(F.col("digest").isin(heavy or [b""]), F.coalesce(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)), F.lit(0)).cast("int")).otherwise(0)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // EACH)
    return rows.withColumn("salt", salt).repartition(tasks, "digest", "salt")


def index(rows: DataFrame) -> DataFrame:
    """digest, salt, rows of the group, its list, and its text where there is more than one row to compare.

    The list is computed once for each group of identical texts that lies together.
    """
    # `least` has no reader: it keeps the rows' columns, so that the join below reads the same shuffle
    groups = rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, salts, copies, many in chunked(batches, "digest", "salt", "copies", "text"):
            kept = [x if n > 1 else None for x, n in zip(many, copies, strict=True)]
            lists = [boundaries(x) for x in many]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(salts, pa.int32()), pa.array(copies, pa.int64()), pa.array(lists, pa.binary()), pa.array(kept, pa.string())], ["digest", "salt", "copies", "list", "kept"])

    return groups.select("digest", "salt", "copies", "least", "text").mapInArrow(run, "digest binary, salt int, copies long, list binary, kept string")


def cut(docs: DataFrame, seed: int = SEED, cut_rate: int = CUT_RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output of every row.

    A null text is empty and stays plain, as does one that holds a mark; a null
    id is seeded by the empty string; rows equal in id and text are cut alike;
    an empty table gives an empty result.
    """
    rows = dealt(texts(docs, id_col, text_col))
    found = index(rows).hint("shuffle_hash")
    joined = rows.join(found, ["digest", "salt"])
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("drawn"), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when(marked | (h[2] % 100 >= cut_rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    own = F.when((F.col("copies") == 1) | (F.col("text") == F.col("kept")), F.col("list"))
    asked = joined.withColumn("drawn", drawn).select("doc_id", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"), own.alias("list"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, h1, h2, forms, lists, many in chunked(batches, "doc_id", "h1", "h2", "form", "list", "text"):
            out: list[tuple] = []
            for a, b, kind, data, text in zip(h1, h2, forms, lists, many, strict=True):
                own = EliasFano(boundaries(text) if data is None else data)
                if kind == "plain":
                    out.append((own.n, None, None, text))
                    continue
                a, b = sorted((own.select(a % (own.n + 1)), own.select(b % (own.n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                whole = f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if kind == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                out.append((own.n, a, b - a, whole))
            n, before, inside, output = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return asked.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(done: DataFrame, name: str = "text") -> DataFrame:
    """Rows of `cut` with the exact text, rebuilt from output and form alone.

    No mark overlaps another or itself, and no cut text holds one, so the
    marks in an output are those that `cut` put there.
    """
    part = lambda k: F.element_at(F.split("output", "<[PSM]>"), k)
    text = F.when(F.col("form") == "psm", F.concat(part(2), part(4), part(3))).when(F.col("form") == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.col("output"))
    return done.withColumn(name, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored(cut(read(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


#: Lines as a list and joined slices of it: nothing of the index.
SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
  drawn AS (SELECT *, string_split(text, chr(10)) AS lines, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR suffix(text, chr(10)) THEN 0 ELSE 1 END AS n,
    ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM docs),
  placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {CUT_RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
  ends AS (SELECT *, CASE WHEN a = n THEN length(text) ELSE coalesce(list_sum(list_transform(lines[1:a], lambda x: length(x) + 1)), 0) END::BIGINT AS p,
    CASE WHEN b = n THEN length(text) ELSE coalesce(list_sum(list_transform(lines[1:b], lambda x: length(x) + 1)), 0) END::BIGINT AS q FROM placed),
  parts AS (SELECT *, substring(text, 1, p) AS prefix, substring(text, p + 1, q - p) AS middle, substring(text, q + 1) AS rest FROM ends)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || rest || '<M>' || middle ELSE '<S>' || rest || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || rest END) AS restored_sha256 FROM parts"""
