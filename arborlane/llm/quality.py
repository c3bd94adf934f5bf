"""Operator 4, quality rules: n-gram perplexity between language-specific bands.

Spark counts the byte 4-grams of all documents.  From them comes a modified
Kneser-Ney model: the top order from counts, the lower ones from how many
different bytes precede an n-gram, three discounts for each order by its counts
of counts, interpolated down to the uniform distribution over 256 symbols.  It
is kept in sorted arrays of n-gram keys with their shares beside them, every
n-gram and context on its own: 8 bytes for each different 4-gram, context and
3-gram of the corpus, collected once and broadcast.

A text's level is the mean logarithm of its words' bits (each word with what
follows it up to the next), so its perplexity's logarithm, averaged by ratio:
a few dear words don't hide many cheap ones, as they do in a plain mean of
bits, so text strewn with marks lies low and noise lies high.  For each language
the levels' median, the median distance of those below it and that of those
above it give a lower band (repeated, boilerplate-like text) and an upper band
(noise), each by its own side's spread and wider for short texts.  All come from
a histogram that Spark sums by language, so they are the same however the table
is dealt.  Each value of `lang` has bands of its own, null too; they are
broadcast up to a number of languages and joined by shuffle beyond it.

Beside the bands, the base rules reject short texts and texts that repeat
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, Words, checkpointed, chunked, compacted, grams, mix, pieces, read, scan_partitions, sum_by, unused

ORDER = 4
#: Base rules: least words, the highest percentage of words in repeated windows, words of a window.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: A band's distance from the middle: so many deviations of its side (at least LEAST_DEVIATION), times the root of 1 + SHORT / words.
DEVIATIONS, LEAST_DEVIATION, SHORT = 4.0, 0.01, 60.0
#: Bins of the histogram of levels in 1, languages whose bands are broadcast at the most.
BINS, BROADCAST = 1024, 50_000
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, level double"


def _slot(context: np.ndarray) -> np.ndarray:
    """The place of three bytes among the top order's contexts: their own number, so no two share one."""
    return context


def count_grams(texts: DataFrame) -> DataFrame:
    """key (a 4-gram of bytes, the oldest first) and n over all rows of column text; counts combine in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def merged() -> None:
            all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(all_keys, kind="stable")
            all_keys, all_counts = all_keys[order], all_counts[order]
            first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
            keys[:], counts[:] = [all_keys[first]], [np.add.reduceat(all_counts, first)]

        for (many,) in chunked(batches, "text"):
            k, n = np.unique(grams([x.encode("utf-8") for x in many], ORDER)[0], return_counts=True)
            keys.append(k.astype(np.int64)), counts.append(n.astype(np.int64))
            size += len(k)
            if size > 2_000_000:
                merged()
                size = len(keys[0])
        if keys:
            merged()
            for at in range(0, len(keys[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][at : at + 50_000]), pa.array(counts[0][at : at + 50_000])], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


class KneserNey:
    """The model; `top` and `lower` are sorted (key, count) arrays of the highest order (4-grams) and the continuation counts of three bytes."""

    def __init__(self, top: tuple[np.ndarray, np.ndarray], lower: tuple[np.ndarray, np.ndarray]):
        uniform = np.full(256, 1 / 256)
        two = np.unique(lower[0] & 0xFFFF, return_counts=True)
        one = np.unique(two[0] & 0xFF, return_counts=True)
        share, back = self._order((np.asarray(one[0]), one[1]), 1)
        self.p1 = back[0] * uniform
        self.p1[one[0]] += share
        share, back = self._order(two, 256)
        self.p2 = (back[:, None] * self.p1[None, :]).ravel()
        self.p2[two[0]] += share
        share, self.back3 = self._order(lower, 1 << 16)
        self.keys3, self.share3 = lower[0].astype(np.uint32), share.astype(np.float32)
        contexts, at = np.unique(top[0] >> 8, return_inverse=True)
        share, back = self._order((at << 8, top[1]), len(contexts))
        self.contexts, self.back4 = contexts.astype(np.uint32), back.astype(np.float32)
        self.keys4, self.share4 = top[0].astype(np.uint32), share.astype(np.float32)

    @staticmethod
    def _order(table: tuple[np.ndarray, np.ndarray], contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """Each n-gram's discounted share of its context, and what each context leaves for the lower order."""
        keys, counts = table[0].astype(np.int64), table[1].astype(np.float64)
        n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        discount = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 1) if k < 3 and n[k] else 0.5 for k in range(3)]
        off = np.minimum(np.array([0.0, *discount])[np.minimum(counts, 3).astype(int)], counts)
        context = keys >> 8
        total = np.bincount(context, weights=counts, minlength=contexts)
        left = np.bincount(context, weights=off, minlength=contexts)
        back = np.divide(left, total, out=np.ones(contexts), where=total > 0)
        return np.divide(counts - off, total[context]), back

    @staticmethod
    def _find(keys: np.ndarray, share: np.ndarray, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, share[at], missing)

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Of the last byte of each 4-gram, given the others."""
        key = key.astype(np.int64)
        three = key & 0xFFFFFF
        p = self._find(self.keys3, self.share3, three.astype(np.uint32)) + self.back3[three >> 8] * self.p2[key & 0xFFFF]
        slot = _slot(key >> 8)
        return self._find(self.keys4, self.share4, (slot * 256 + (key & 0xFF)).astype(np.uint32)) + self._find(self.contexts, self.back4, slot.astype(np.uint32), 1.0) * p

    def byte_bits(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bits of each byte and of each text's end after its bytes, and where each text starts."""
        keys, start = grams(encoded, ORDER)
        some, where = np.unique(keys, return_inverse=True)
        return -np.log2(self.probability(some))[where], start

    def bits(self, encoded: list[bytes]) -> np.ndarray:
        """Each text's bits, its end with them."""
        return sum_by(*self.byte_bits(encoded))


def train(texts: DataFrame) -> KneserNey:
    """The model of column text.  A row for each different 4-gram and 3-gram of bytes comes to the driver."""
    counts = checkpointed(count_grams(texts).coalesce(max(1, scan_partitions(texts) // 4)))
    top = counts.select(F.col("key").alias("k"), "n")
    lower = counts.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("k")).agg(F.count("*").alias("n"))
    arrays = []
    for table in (top, lower):
        got = table.toArrow()
        k, n = got["k"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(k)
        arrays.append((k[order], n[order]))
    return KneserNey(*arrays)


def rule_counts(many: list[str], words: Words | None = None) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    encoded = [x.encode("utf-8") for x in many]
    words = words or Words(encoded)
    n = len(many)
    doc_of = np.repeat(np.arange(n), np.diff(np.append(words.doc_start, len(words.bytes))))
    point = (words.bytes & 0xC0) != 0x80
    inside = np.zeros(len(words.bytes) + 1, np.int8)
    inside[words.start] += 1
    np.add.at(inside, words.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    word_chars = np.bincount(doc_of[inside & point], minlength=n)
    symbols = np.bincount(doc_of[_SYMBOL[words.bytes]], minlength=n)
    lines = np.zeros(n, np.int64)
    for i, x in enumerate(encoded):
        own = [p for p in x.split(b"\n") if p and p.strip(b" \t\r\x0b\x0c")]
        lines[i] = len(own) - len(set(own))
    repeated = np.zeros(n, np.int64)
    if len(words.start) >= WINDOW:
        h = words.hash
        window = np.zeros(len(h) - WINDOW + 1, U64)
        for k in range(WINDOW):
            window = mix(window * U64(0x9E3779B97F4A7C15) + h[k : k + len(window)])
        whole = words.doc[: len(window)] == words.doc[WINDOW - 1 :]
        window = mix(window ^ mix(words.doc[: len(window)].astype(U64) + U64(1)))
        at = np.flatnonzero(whole)
        order = at[np.argsort(window[at], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
        cover = np.zeros(len(h) + 1, np.int64)
        cover[twice] += 1
        np.add.at(cover, twice + WINDOW, -1)
        repeated = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [words.n_words, word_chars, symbols, lines, repeated]


def levels(encoded: list[bytes], words: Words, model: KneserNey) -> np.ndarray:
    """Each text's mean logarithm of its words' bits; the last word's hold the text's end; 0 without words."""
    bits, start = model.byte_bits(encoded)
    total = np.concatenate([[0.0], np.cumsum(bits)])
    ends = np.append(start, len(bits))[1:]  # Words puts one separator after each text, where its end mark is here
    to = np.minimum(np.append(words.start[1:], len(bits)), ends[words.doc]) if len(words.start) else words.start
    logs = np.log(np.maximum(total[to] - total[words.start], 2.0**-10))
    return np.bincount(words.doc, weights=logs, minlength=len(encoded)) / np.maximum(words.n_words, 1)


def measured(many: list[str], model: KneserNey) -> list[np.ndarray]:
    """The columns of FIELDS."""
    encoded = [x.encode("utf-8") for x in many]
    words = Words(encoded)
    counts = rule_counts(many, words)
    level = levels(encoded, words, model)
    failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > MOST_REPEATED * counts[0])
    return [*counts, failed, level]


def language(lang_col: str | None):
    return F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")


def bands(scores: DataFrame) -> DataFrame:
    """place (the language), middle, and below and above (the deviations of either side) of the levels of all rows (place, level) that pass the base rules; a row for each language."""
    binned = scores.where("not base_failed").groupBy("place", F.floor(F.col("level") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    own, b, m, n = W.partitionBy("place"), F.col("bin"), F.col("m"), F.col("n")  # some thousand bins of a language
    half = lambda part, of: 2 * F.sum(part).over(of) >= F.sum(part).over(own)
    rows = binned.withColumn("up", half(n, own.orderBy("bin"))).withColumn("m", F.min(F.when(F.col("up"), b)).over(own))
    low, high = F.when(b <= m, n), F.when(b >= m, n)
    rows = rows.select("place", "m", F.when((b <= m) & half(low, own.orderBy(b.desc())), m - b).alias("low"), F.when((b >= m) & half(high, own.orderBy("bin")), b - m).alias("high"))
    deviation = lambda c: F.greatest(F.lit(LEAST_DEVIATION), 1.4826 * F.min(c) / BINS)
    return rows.groupBy("place").agg(((F.min("m") + 0.5) / BINS).alias("middle"), deviation("low").alias("below"), deviation("high").alias("above"))


def with_bands(rows: DataFrame, place: str, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rows with their language's bands as `names`, null where it has none."""
    (at,) = unused(rows, "at")
    found = checkpointed(found.toDF(at, *names))
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST else found, F.col(place).eqNullSafe(F.col(at)), "left").drop(at)


def limits(n_words, middle, below, above):
    """The lower and the upper band of levels for a text of so many words."""
    wide = F.lit(DEVIATIONS) * F.sqrt(1 + F.lit(SHORT) / F.greatest(n_words, F.lit(1)))
    return middle - below * wide, middle + above * wide


def inside(level, n_words, middle, below, above):
    """Whether a level lies within its language's bands; true where there are none."""
    return F.coalesce(level.between(*limits(n_words, middle, below, above)), F.lit(True))


def _measure(docs: DataFrame, model: KneserNey, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), language(lang_col).alias("place"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, place, many in chunked(batches, "doc_id", "place", "text", limit=1 << 20):
            own = measured(many, model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(place, pa.string()), *[pa.array(x.astype(np.int64)) for x in own[:5]], pa.array(own[5]), pa.array(own[6])], ["doc_id", "place", *[f.split()[0] for f in FIELDS.split(", ")]])

    return rows.mapInArrow(run, f"doc_id long, place string, {FIELDS}")


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """Rule counts, perplexity and verdict of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, bits (the geometric mean of the words' bits), lower and upper
    (the bands of bits) and kept.
    A null text is empty and fails; a null lang is a language of its own;
    repeated rows each give a row; an empty table gives an empty result.
    """
    model = train(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    scores = compacted(_measure(docs, model, id_col, text_col, lang_col))
    rows = with_bands(scores, "place", bands(scores), ("middle", "below", "above"))
    band = [F.col(c) for c in ("n_words", "middle", "below", "above")]
    lower, upper = limits(*band)
    return rows.select(
        *["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        F.exp("level").alias("bits"),
        F.exp(lower).alias("lower"),
        F.exp(upper).alias("upper"),
        (~F.col("base_failed") & inside(F.col("level"), *band)).alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that `rules` keeps, all their columns unchanged; texts never shuffle.

    Null and empty texts fail the base rules and go; a null lang is a language
    of its own; repeated rows share a verdict; an empty table stays empty.
    """
    place, own, middle, below, above = unused(docs, "place", "own", "middle", "below", "above")
    model = train(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    lang = "lang" if "lang" in docs.columns else None
    found = bands(compacted(_measure(docs, model, "doc_id", "text", lang).select("place", "base_failed", "level")))

    @F.arrow_udf("struct<base_failed:boolean,n_words:long,level:double>")
    def measure(text: pa.Array) -> pa.Array:
        many = [x or "" for x in text.to_pylist()]
        own = [np.concatenate(x) for x in zip(*[measured(many[part], model) for part in pieces(many)], strict=True)]
        return pa.StructArray.from_arrays([pa.array(own[5]), pa.array(own[0].astype(np.int64)), pa.array(own[6])], ["base_failed", "n_words", "level"])

    rows = docs.withColumns({place: language(lang), own: measure.asNondeterministic()("text")})
    rows = with_bands(rows, place, found, (middle, below, above))
    good = ~F.col(f"{own}.base_failed") & inside(F.col(f"{own}.level"), F.col(f"{own}.n_words"), F.col(middle), F.col(below), F.col(above))
    return rows.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents"))
