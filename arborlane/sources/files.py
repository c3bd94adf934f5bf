"""CSV, Parquet, JSON and model artefacts, in any store that Spark reads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash32, unused
from ..operators.clean import drop_header_rows, rename_target, tag_day, trim_columns
from ..operators.sampling import half_even

#: Fixed value: sampling scans take their share of every so many rows.
CHUNK_ROWS = 50_000


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def content_length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, from its metadata; FileNotFoundError if there's none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return fs.getContentSummary(p).getLength()


def discover(spark: SparkSession, where: str | list[str], suffix: str = ".csv") -> list[str]:
    """Sources of a list, a folder or a file, sorted; FileNotFoundError if there's none."""
    found: list[str] = []
    for path in [where] if isinstance(where, str) else where:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).isFile() or path.endswith(suffix):
            found.append(path)
        else:
            found += [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().endswith(suffix)]
    if not found:
        raise FileNotFoundError(f"no {suffix} source in {where}")
    return sorted(found)


def listed(spark: SparkSession, path: str, suffix: str) -> bool:
    """Whether a folder holds a file of the suffix."""
    fs, p = _fs(spark, path)
    return fs.exists(p) and any(s.getPath().getName().endswith(suffix) for s in fs.listStatus(p))


def scan_csv(spark: SparkSession, sources: str | list[str]) -> DataFrame:
    """All columns as text; a path may hold several, split by |."""
    paths = sources.split("|") if isinstance(sources, str) else sources
    for p in paths:
        if "*" not in p and not exists(spark, p):
            raise FileNotFoundError(p)
    return spark.read.csv(paths, header=True, inferSchema=False)


def load_flows(spark: SparkSession, where: str | list[str], tag: bool = True) -> DataFrame:
    """Discovered CSV files as one table: names trimmed, target renamed, repeated headers dropped, rows tagged by day."""
    frames = []
    for source in discover(spark, where):  # files may differ in columns; each is one lazy scan
        df = rename_target(trim_columns(scan_csv(spark, [source])))
        df = tag_day(df) if tag else df
        frames.append(drop_header_rows(df) if "Label" in df.columns else df)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def numbered_csv(spark: SparkSession, sources: str | list[str], source: str = "source", row: str = "row") -> DataFrame:
    """`scan_csv` with each row's file and its number in it, from 0.

    Rows count within the blocks that files are read by; the rows of a file's
    blocks before are added, so no task holds more than a block.
    """
    rows = scan_csv(spark, sources)
    at, order, n = unused(rows, "__at", "__order", "__n")
    rows = rows.select("*", F.col("_metadata.file_path").alias(source), F.col("_metadata.file_block_start").alias(at), F.monotonically_increasing_id().alias(order))
    blocks = rows.groupBy(source, at).agg(F.count("*").alias(n))
    before = W.partitionBy(source).orderBy(at)  # a row for each block of a file
    blocks = blocks.select(source, at, (F.sum(n).over(before) - F.col(n)).alias(n))
    local = F.row_number().over(W.partitionBy(source, at).orderBy(order)) - 1
    return rows.withColumn(row, local.cast("long")).join(blocks, [source, at]).withColumn(row, F.col(row) + F.col(n)).drop(at, order, n)


def chunk_sample(df: DataFrame, source: str, row: str, fraction: float, seed: int = 0, chunk: int = CHUNK_ROWS) -> DataFrame:
    """The same whole number of rows of every chunk of 50,000 rows of a source; `row` numbers a source's rows from 0."""
    c, r, n = unused(df, "__c", "__r", "__n")
    rows = df.withColumn(c, F.floor(F.col(row) / chunk))
    w = W.partitionBy(source, c)  # a chunk has 50,000 rows at the most
    ranked = rows.withColumn(r, F.row_number().over(w.orderBy(hash32(F.col(c) + seed, source, row), row))).withColumn(n, F.count("*").over(w))
    return ranked.where(F.col(r) <= half_even(F.col(n) * fraction)).drop(c, r, n)


def count_rows(spark: SparkSession, sources: list[str]) -> DataFrame:
    """source (a file) and n, its records without the header; one job for all, and no column is parsed.

    A record ends at a line end outside quotes; a doubled or backslashed quote
    closes nothing, and blank lines aren't records.  Files are read by blocks:
    each block counts the records that end in it both ways, as if it began
    outside and inside quotes, and the quotes before say which count holds.
    """
    for p in sources:
        if "*" not in p and not exists(spark, p):
            raise FileNotFoundError(p)
    text = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(text) - F.length(F.translate(text, '"', ""))
    lines = spark.read.text(sources).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"), (quotes % 2).cast("byte").alias("odd"), (F.trim("value") == "").alias("blank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, outside_n, inside_n = None, 0, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*block, inside, outside_n, inside_n)], ["source", "at", "odd", "outside_n", "inside_n"])

        for b in batches:
            source, at = b.column(0).to_pylist(), b.column(1).to_numpy()
            odd, blank = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(zero_copy_only=False)
            edges = [0, *[i for i in range(1, len(source)) if source[i] != source[i - 1] or at[i] != at[i - 1]], len(source)]
            for first, end in zip(edges, edges[1:], strict=False):
                if block != (source[first], int(at[first])):
                    if block:
                        yield row()
                    block, inside, outside_n, inside_n = (source[first], int(at[first])), 0, 0, 0
                after = (inside + np.cumsum(odd[first:end])) % 2  # inside quotes at each line's end, had the block begun outside
                empty = blank[first:end] & (odd[first:end] == 0)
                outside_n += int(((after == 0) & ~empty).sum())
                inside_n += int(((after == 1) & ~empty).sum())
                inside = int(after[-1])
        if block:
            yield row()

    blocks = lines.mapInArrow(run, "source string, at long, odd long, outside_n long, inside_n long")
    before = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)  # a row for each block of a file
    blocks = blocks.withColumn("began", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    records = F.sum(F.when(F.col("began") == 0, F.col("outside_n")).otherwise(F.col("inside_n"))) + F.sum("odd") % 2  # a quote left open ends with the file
    return blocks.groupBy("source").agg(F.greatest(records - 1, F.lit(0)).cast("long").alias("n"))


def count_parquet(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table: the scan reads no column, only the row counts in its footers."""
    return spark.read.parquet(path).count()


def cached_counts(spark: SparkSession, sources: list[str], cache: str) -> dict[str, int]:
    """Rows of each source from a JSON table; only sources that it lacks are counted, in one job, and added."""
    known = {r.source: r.n for r in spark.read.schema("source string, n long").json(cache).collect()} if exists(spark, cache) else {}
    lacking = [s for s in sources if s not in known]
    if lacking:
        found = {r.source: r.n for r in count_rows(spark, lacking).collect()}  # a row for each file
        names = {s: _fs(spark, s)[0].makeQualified(_fs(spark, s)[1]).toUri().getPath() for s in lacking}
        of = [(urlsplit(f).path if "://" in f else f.split(":", 1)[-1], n) for f, n in found.items()]
        fresh = [(s, sum(n for f, n in of if unquote(f) == names[s] or unquote(f).startswith(names[s] + "/"))) for s in lacking]
        spark.createDataFrame(fresh, "source string, n long").coalesce(1).write.mode("append").json(cache)
        known |= dict(fresh)
    return {s: known[s] for s in sources}


def row_summary(counts: DataFrame) -> DataFrame:
    """total, mean (whole), least and most rows of a source."""
    return counts.agg(F.sum("n").alias("total"), F.floor(F.avg("n")).cast("long").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def mirrored(spark: SparkSession, sources: list[str], mirror: str) -> DataFrame:
    """CSV sources as Parquet, written the first time; a mirror counts only when its write is complete.

    It holds one table for each set of sources as they are: a source that
    changes (its size or time) is mirrored anew.
    """
    state = []
    for source in sorted(sources):
        fs, p = _fs(spark, source)
        if not fs.exists(p):
            raise FileNotFoundError(source)
        status = fs.getFileStatus(p)
        state.append([source, status.getLen(), status.getModificationTime()])
    table = f"{mirror}/{hashlib.sha256(json.dumps(state).encode()).hexdigest()[:32]}"
    if not exists(spark, f"{table}/_SUCCESS"):
        load_flows(spark, sources).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON document; FileNotFoundError if there's none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """One JSON document as a text table of one row; readers see it when it's complete."""
    spark.createDataFrame([(json.dumps(document, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; the commit protocol shows the files together or not at all."""
    df.write.mode("overwrite").csv(path, header=True)


def write_shards(df: DataFrame, path: str, shard: str = "shard_id", split: str = "split", files: int = 8) -> None:
    """Parquet in folders by split and shard; a large shard goes to several files, a row's file by its hash, so a retried task deals alike."""
    (part,) = unused(df, "__f")
    row = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files)).cast("int")
    df.withColumn(part, row).repartition(split, shard, part).drop(part).write.mode("overwrite").partitionBy(split, shard).parquet(path)


def append_part(df: DataFrame, table: str, part: int) -> None:
    """A delta: only new rows, in a partition of its own; writing a part again replaces it."""
    df.write.mode("overwrite").parquet(f"{table}/part={part}")


def purge_parts(spark: SparkSession, table: str, from_part: int) -> int:
    """Deletes the parts from a number on; how many there were."""
    fs, p = _fs(spark, table)
    if not fs.exists(p):
        return 0
    gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part=") and int(s.getPath().getName()[5:]) >= from_part]
    for path in gone:
        fs.delete(path, True)
    return len(gone)


def complete_parts(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the parts whose write ended."""
    fs, p = _fs(spark, table)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[5:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("part=") and exists(spark, f"{s.getPath()}/_SUCCESS"))
