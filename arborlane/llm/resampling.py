"""Operator 5, quality classifier: importance resampling by hashed n-grams.

Two generative models of hashed byte n-grams are counted, one of target text
(labelled good) and one of all raw text.  A document's log weight is the sum of
its n-grams' log ratios, tempered so that a longer text counts as `EVIDENCE`
n-grams (else small differences between languages add up in long texts);
documents are then sampled without replacement, with those weights, by Gumbel
top-k: the k largest of log weight plus Gumbel noise.
k may be given.  Else it is the number of documents that weigh as much as good text does: their log
weight is at most three deviations of the noise (`MARGIN`) below the `QUANTILE`
of the weights of all documents labelled good.  Fewer than `LEAST_GOOD` of those
don't tell such a quantile (and their own n-grams make up the target model, so
they outweigh other good text by far); then k counts from `FLOOR` on.

The raw model counts every document.  The target model takes at most
`TARGET_LABELS` labelled documents (those with the smallest hashes), whose ids
are broadcast; so is the table of ratios, of fixed size.  The k-th largest key
is found by counting leading digits of the keys, a few thousand counts at a
time, so nothing is sorted or gathered; the noise hangs on doc_id and text, so
a lost task draws the same again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, chunked, compacted, grams, mix, pieces, read, sum_by, texts

#: Sizes of the n-grams, places of each size's hash table, added to each count.
SIZES, PLACES, SMOOTHING = (2, 4), 1 << 16, 0.5
TARGET_LABELS = 20_000
#: n-grams that a text counts for at the most; k counts no log weight below this; seed of the noise.
EVIDENCE, FLOOR, SEED = 100, -30.0, 11
#: Share of the good documents' weights that lies below the one k is taken from, the distance to it, and how many good documents that needs.
QUANTILE, MARGIN, LEAST_GOOD = 0.01, 3 * math.pi / math.sqrt(6), 1000
_ID = -(2**63)


def places(encoded: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    keys, start = grams(encoded, n)
    return (mix(keys + U64(n)) >> U64(48)).astype(np.int64), start


def count(rows: DataFrame, targets: frozenset[int]) -> np.ndarray:
    """Counts of (raw or target, size, place) over all rows (doc_id, text)."""
    shape = (2, len(SIZES), PLACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for ids, many in chunked(batches, "doc_id", "text"):
            encoded = [x.encode("utf-8") for x in many]
            good = np.array([i in targets for i in ids])
            for k, n in enumerate(SIZES):
                where, start = places(encoded, n)
                total[0, k] += np.bincount(where, minlength=PLACES)
                if good.any():
                    at = np.repeat(good, np.diff(np.append(start, len(where))))
                    total[1, k] += np.bincount(where[at], minlength=PLACES)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some], pa.int64())], ["place", "n"])

    sums = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(math.prod(shape), np.int64)
    out[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(shape)


def ratios(counts: np.ndarray) -> np.ndarray:
    """log(target probability / raw probability) of each place; 0 everywhere if there's no target text."""
    if not counts[1].any():
        return np.zeros(counts.shape[1:])
    smooth = counts + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]) / len(SIZES)


def target_ids(labels: DataFrame, bound: int = TARGET_LABELS) -> frozenset[int]:
    """At most `bound` ids labelled good, those with the smallest hashes."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return frozenset(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).collect())


def _weights(many: list[str], table: np.ndarray) -> np.ndarray:
    encoded = [x.encode("utf-8") for x in many]
    total = np.zeros(len(many))
    for k, n in enumerate(SIZES):
        where, start = places(encoded, n)
        total += sum_by(table[k][where], start)
        size = np.diff(np.append(start, len(where)))
    return total * np.minimum(1.0, EVIDENCE / np.maximum(size, 1)) if encoded else total


def gumbel(ids: list[int | None], many: list[str], seed: int = SEED) -> np.ndarray:
    """Noise that hangs on seed, doc_id and text alone."""
    u = np.array([xxhash.xxh64_intdigest(f"{_ID if i is None else i}:{xxhash.xxh64_hexdigest(t)}", seed) for i, t in zip(ids, many, strict=True)], U64)
    return -np.log(-np.log(((u >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53))


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits - 1, bits)


def unordered(key: int) -> float:
    """The double that `ordered` made a long of."""
    return float(np.array([key if key >= 0 else -(2**63) - key - 1], np.int64).view(np.float64)[0])


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the long column `key`, by its digits in base 4096 from the top."""
    low, width = -(2**63), 64
    rest = keys
    while width:
        step = max(0, width - 12)
        digit = F.shiftrightunsigned(F.col("key") - F.lit(low), step) if low != -(2**63) else F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(low)), step)
        counts = sorted(((r[0], r[1]) for r in rest.groupBy(digit.alias("d")).count().collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                break
            k -= n
        low += d << step
        rest = keys.where(F.col("key").between(low, low + (1 << step) - 1))
        width = step
    return low


class Sampler:
    """The fitted models and the threshold that Gumbel top-k comes to."""

    def __init__(self, table: np.ndarray, threshold: int | None, seed: int = SEED):
        self.table, self.threshold, self.seed = table, threshold, seed

    def keys(self, ids: list, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        weight = _weights(many, self.table)
        return weight, weight + gumbel(ids, many, self.seed)

    def selected(self, keys: np.ndarray) -> np.ndarray:
        return np.zeros(len(keys), bool) if self.threshold is None else ordered(keys) >= self.threshold


def _scored(rows: DataFrame, sampler: Sampler) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, many in chunked(batches, "doc_id", "text"):
            weight, key = sampler.keys(ids, many)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(weight), pa.array(key), pa.array(ordered(key)), pa.array(ordered(weight))], ["doc_id", "log_weight", "gumbel_key", "key", "weight_key"])

    return rows.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double, key long, weight_key long")


def good_floor(scores: DataFrame, labels: DataFrame, least: float = FLOOR) -> float:
    """The log weight from which k counts: by the weights of all rows labelled good, `least` at least."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    keys = scores.join(good, "doc_id", "left_semi").select(F.col("weight_key").alias("key"))
    n = keys.count()
    if n < LEAST_GOOD:
        return least
    return max(least, unordered(kth_largest(keys, n - int(QUANTILE * n))) - MARGIN)


def fit(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None, seed: int = SEED) -> tuple[Sampler, DataFrame]:
    """The sampler, and the scores (checkpointed) of all rows; a k that isn't given never counts a log weight below `floor`."""
    rows = texts(docs)
    sampler = Sampler(ratios(count(rows, target_ids(labels))), None, seed)
    scores = compacted(_scored(rows, sampler))
    total = scores.count()
    if k is None:
        k = scores.where(F.col("log_weight") >= good_floor(scores, labels, floor)).count()
    if min(k, total) > 0:
        sampler.threshold = kth_largest(scores, min(k, total))
    return sampler, scores


def sample(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key and kept (selected) of every row.

    A null text is empty.  Repeated rows draw the same noise and go together;
    keys equal to the k-th are all selected.  Without labels all weights are 0
    and all rows are selected unless k is given; an empty table gives an empty
    result.
    """
    sampler, scores = fit(docs, labels, floor, k, seed)
    chosen = F.lit(False) if sampler.threshold is None else F.col("key") >= sampler.threshold
    return scores.select("doc_id", "log_weight", "gumbel_key", chosen.alias("kept"))


def keep_selected(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents that are selected, all their columns unchanged; nothing shuffles but counts.

    Null texts are empty, repeated rows go together, an empty table stays empty.
    """
    sampler, _ = fit(docs, labels, floor, k, seed)

    @F.arrow_udf("boolean")
    def chosen(ids: pa.Array, text: pa.Array) -> pa.Array:
        own, many = ids.to_pylist(), [x or "" for x in text.to_pylist()]
        return pa.array(np.concatenate([sampler.selected(sampler.keys(own[part], many[part])[1]) for part in pieces(many)]))

    return docs.where(chosen(F.col("doc_id").cast("long"), F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
