"""Operator 6, language identification: spans of mixed-language text by Viterbi over words.

A word's script narrows the languages to those that use it in training text;
hashed byte n-grams score the word in each of them; a best path through the
words, with a penalty for each switch, gives every word a language.  Runs of
words with one language are the text's spans; the language with most letters is
the text's.

Spark counts n-grams by language over all training rows.  The table has a fixed
number of places for each language that occurs (a closed list of codes), so
what is collected and broadcast doesn't grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Words, chunked, grams, mix, read

#: n-gram sizes, places of each size's hash table, added to each count.
SIZES, PLACES, SMOOTHING = (2, 3, 4), 1 << 15, 0.5
#: What a switch of languages costs, in nats; least share of a language's letters for a script to be its own.
SWITCH, SCRIPT_SHARE = 12.0, 0.01
#: Languages that a model may have at the most: their tables are collected and broadcast (400 KB each).
MOST_LANGUAGES = 256
#: First code points of script ranges, and the scripts (0: others).
_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x1380, "other"), (0x1780, "Khmer"), (0x1800, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"),
]
SCRIPTS = ["other", *sorted({s for _, s in _RANGES} - {"other"})]
UNKNOWN = "und"
TRAIN_FOLD, FOLDS = 1, 3
#: Lower-cases A-Z and makes all white space one character.
_PLAIN = bytes(0x20 if 9 <= b <= 13 else LOWER[b] for b in range(256))
_tables: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """For each code point: -1 if it's no letter, else the number of its script."""
    if not _tables:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        starts = np.array([a for a, _ in _RANGES])
        numbers = np.array([0, *(SCRIPTS.index(s) for _, s in _RANGES)])
        _tables.append(np.where(letters, numbers[np.searchsorted(starts, np.arange(0x110000), "right")], -1).astype(np.int8))
    return _tables[0]


class Chunk:
    """The words of some texts with their letters, scripts and n-gram places."""

    def __init__(self, many: list[str]):
        self.encoded = [x.encode("utf-8").translate(_PLAIN) for x in many]
        self.words = Words(self.encoded)
        raw = self.words.bytes
        points = np.frombuffer("".join(x + "\n" for x in many).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = script_table()[points]
        at = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each code point starts
        is_letter = letter >= 0
        word_of = np.searchsorted(self.words.start, at[is_letter], "right") - 1
        self.letters = np.bincount(word_of, minlength=len(self.words.start)).astype(np.int64)
        self.script = np.zeros(len(self.words.start), np.int64)
        first = np.flatnonzero(np.concatenate([[True], word_of[1:] != word_of[:-1]])) if len(word_of) else np.zeros(0, np.int64)
        self.script[word_of[first]] = letter[is_letter][first]

    def places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The place of the n-gram that ends at each byte, and where each text starts."""
        keys, start = grams(self.encoded, n, pad=0x20)
        return (mix(keys + U64(n)) >> U64(64 - 15)).astype(np.int64), start


class Model:
    """languages, log probabilities (language, size, place) and which scripts each language uses (language, script)."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray, switch: float = SWITCH):
        self.languages, self.table, self.scripts, self.switch = languages, table, scripts, switch

    def word_scores(self, chunk: Chunk) -> np.ndarray:
        """(word, language): the mean over sizes of the sums of log probabilities of the n-grams that end in the word or right after it.

        A word is scored in the languages that use its script only (in all if
        none does) and can't be in the others; words without letters have 0.
        """
        words, n = chunk.words, len(self.languages)
        out = np.zeros((len(words.start), n))
        if not len(words.start):
            return out
        candidate = self.scripts[:, chunk.script]
        candidate = candidate | ~candidate.any(axis=0) | (chunk.letters == 0)
        size = words.end + 1 - words.start  # n-gram places: one for each byte and one after each text, as in words.bytes
        where = [chunk.places(k)[0] for k in SIZES]
        for j in range(n):
            own = np.flatnonzero(candidate[j] & (chunk.letters > 0))
            out[~candidate[j], j] = -np.inf
            if len(own):
                first = np.concatenate([[0], np.cumsum(size[own])[:-1]])
                at = np.repeat(words.start[own] - first, size[own]) + np.arange(int(size[own].sum()))
                out[own, j] = sum(np.add.reduceat(self.table[j, k][where[k][at]], first, dtype=np.float64) for k in range(len(SIZES))) / len(SIZES)
        return out

    def label(self, chunk: Chunk) -> np.ndarray:
        """The language of each word: best paths of all texts, a word of each at a step."""
        words = chunk.words
        score = self.word_scores(chunk)
        n_words = words.n_words
        order = np.argsort(-n_words, kind="stable")
        order = order[n_words[order] > 0]
        first = np.concatenate([[0], np.cumsum(n_words)])[:-1][order]
        length = n_words[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")  # texts of more than t words
        came = np.zeros(score.shape, np.int16)
        each = np.arange(len(self.languages), dtype=np.int16)
        value = score[first].copy() if len(first) else score[:0]
        last = np.zeros(len(order), np.int16)
        for t in range(1, steps):
            m = active[t]
            if m < len(value):
                last[m : len(value)] = value[m:].argmax(axis=1)
                value = value[:m]
            at = first[:m] + t
            best = value.argmax(axis=1)
            top = value[np.arange(m), best] - self.switch
            stay = value >= top[:, None]
            came[at] = np.where(stay, each, best[:, None].astype(np.int16))
            value = np.where(stay, value, top[:, None]) + score[at]
        if len(value):
            last[: len(value)] = value.argmax(axis=1)
        label = np.zeros(len(score), np.int16)
        state = last
        for t in range(steps - 1, -1, -1):
            at = first[: active[t]] + t
            label[at] = state[: active[t]]
            if t:
                state[: active[t]] = came[at, state[: active[t]]]
        return label

    def predict(self, many: list[str]) -> tuple[list[str], list[float], list[list[dict]]]:
        """Each text's language, the share of its letters that are in it, and its spans: start and end word (exclusive), lang."""
        chunk = Chunk(many)
        n, docs = len(self.languages), len(many)
        if not n:
            return [UNKNOWN] * docs, [0.0] * docs, [[] for _ in many]
        label = self.label(chunk).astype(np.int64)
        share = np.bincount(chunk.words.doc * n + label, weights=chunk.letters, minlength=docs * n).reshape(docs, n)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        langs = [self.languages[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
        scores = np.divide(share.max(axis=1), total, out=np.zeros(docs), where=total > 0).tolist()
        spans: list[list[dict]] = [[] for _ in many]
        if len(label):
            doc = chunk.words.doc
            first = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])]))
            begin = np.concatenate([[0], np.cumsum(chunk.words.n_words)])
            for a, b in zip(first, np.append(first[1:], len(label)), strict=True):
                d = doc[a]
                if total[d]:
                    spans[d].append({"start": int(a - begin[d]), "end": int(b - begin[d]), "lang": self.languages[label[a]]})
        return langs, scores, spans


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows with a lang; a null text is empty."""
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    width = len(SIZES) * PLACES
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for langs, many in chunked(batches, "lang", "text"):
            for lang in sorted(set(langs)):
                chunk = Chunk([x for x, own in zip(many, langs, strict=True) if own == lang])
                total = totals.setdefault(lang, np.zeros(width + len(SCRIPTS), np.int64))
                for k, n in enumerate(SIZES):
                    total[k * PLACES : (k + 1) * PLACES] += np.bincount(chunk.places(n)[0], minlength=PLACES)
                total[width:] += np.bincount(chunk.script, weights=chunk.letters, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(total[some])], ["lang", "place", "n"])

    sums = rows.mapInArrow(run, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(sums["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((len(languages), width + len(SCRIPTS)))
    counts[[number[x] for x in sums["lang"].to_pylist()], sums["place"].to_numpy()] = sums["n"].to_numpy()
    smooth = counts[:, :width].reshape(-1, len(SIZES), PLACES) + SMOOTHING
    letters = counts[:, width:]
    scripts = letters > SCRIPT_SHARE * letters.sum(axis=1, keepdims=True)
    return Model(languages, np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32), scripts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (the row is in the fold kept from training), lang_pred, score, n_spans and spans of every row.

    `und` with score 0 for a null text, one without letters, and if nothing was
    learned; without letters there are no spans.  Ties go to the first language in order.  Repeated rows each give
    a row; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (fold(id_col) == TRAIN_FOLD).alias("held_out"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, many in chunked(batches, "doc_id", "held_out", "text"):
            langs, scores, found = model.predict(many)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([len(x) for x in found], pa.int64()), pa.array(found, spans)], ["doc_id", "held_out", "lang_pred", "score", "n_spans", "spans"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long, spans array<struct<start:long,end:long,lang:string>>")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text (null: empty), modulo the number of folds."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % FOLDS


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(fold() != TRAIN_FOLD)))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"), s.lang)), ","))
