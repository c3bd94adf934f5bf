"""Operator 8, packing: minimum bin slack over the multiset of remaining lengths.

Each task packs the documents that it reads, so nothing shuffles.  A document
of more than a window's tokens gives whole windows and a rest.  The rests wait
in a bounded pool, of which only a count for each length matters: a window
takes the longest rest and, by subset sums in a bitset (one big integer, a
step for each power-of-two share of a length's count), the multiset of rests
that fills it closest to capacity; the counts are tracked back through the
steps.  A window with slack takes the head of one more rest.  The last rests of
a task, under one window, go into sequences of powers of two, which need no
padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import vocabulary
from .common import chunked, kept, read, texts

CAPACITY = 4096
#: Tokens in the pool when packing begins, and of which it leaves half for a better choice later.
POOL = 1 << 20
#: Words whose tokens a worker keeps.
WORDS = 700_000
#: The splitting pattern of the vocabulary, in Latin-1: contractions, letters, single digits, other characters.
_LETTERS, _DIGITS, _BLANK = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANK}{_LETTERS}{_DIGITS}]+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """How many of each length (its index in counts) fill the capacity closest, the longest that fits among them; empty if none fits."""
    lengths = np.flatnonzero(counts[: capacity + 1])[::-1].tolist()
    if not lengths:
        return {}
    first = lengths[0]
    room = capacity - first
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or sums >> room & 1:
            continue
        left, take = min(int(counts[length]) - (length == first), room // length), 1
        while left > 0 and not sums >> room & 1:
            share = min(take, left)
            steps.append((sums, length, share))
            sums |= sums << (share * length) & mask
            left -= share
            take *= 2
    chosen, at = {first: 1}, sums.bit_length() - 1
    for before, length, share in reversed(steps):
        if not before >> at & 1:
            at -= share * length
            chosen[length] = chosen.get(length, 0) + share
    return chosen


class Packer:
    """Pieces (doc, start, ids, tokens of the document) in, (doc, start, length, crc32, tokens, sequence, offset) out."""

    def __init__(self, capacity: int = CAPACITY, pool: int = POOL, first_sequence: int = 0):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.waiting: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        self.counts = np.zeros(capacity + 1, np.int64)
        self.tokens = 0
        self.out: list[tuple] = []

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2])
        if n:
            self.waiting[n].append(piece)
            self.counts[n] += 1
            self.tokens += n

    def _pop(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.tokens -= length
        return self.waiting[length].pop()

    def _cut(self, length: int, size: int) -> tuple:
        """The first `size` tokens of a waiting piece; the rest waits on."""
        doc, start, ids, total = self._pop(length)
        self._wait((doc, start + size, ids[size:], total))
        return doc, start, ids[:size], total

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """ids: little-endian unsigned 32-bit."""
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, ids[start : start + self.capacity], len(ids))])
        self._wait((doc, whole, ids[whole:].copy(), len(ids)))  # not a view, which would keep the whole text's ids
        if self.tokens >= self.pool:
            self._fill(max(self.pool // 2, self.capacity))

    def _sequence(self, size: int) -> None:
        pieces = [self._pop(length) for length, n in sorted(best_fill(self.counts, size).items(), reverse=True) for _ in range(n)]
        slack = size - sum(len(p[2]) for p in pieces)
        if slack:  # every rest that would fit is in; the shortest of the others is longer than the slack
            pieces.append(self._cut(int(np.flatnonzero(self.counts[slack:])[0]) + slack, slack))
        self._emit(pieces)

    def _fill(self, leave: int) -> None:
        while self.tokens >= leave:
            self._sequence(self.capacity)

    def finish(self) -> None:
        self._fill(self.capacity)
        size = self.capacity
        while self.tokens:
            while size > self.tokens:
                size //= 2
            self._sequence(size)


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    """The tokenizers library's ids of texts; the library encodes each word once.

    In texts of Latin-1 characters, which the vocabulary's normalizer only
    lower-cases one by one, words are the pieces of its own splitting pattern;
    they are encoded many at a time, told apart by the tokens that end words.
    Other texts, and those that may hold the vocabulary's marks, split at ASCII
    white space, which it drops.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends_word[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str | bytes, bytes] = {}

    def _one_by_one(self, new: list[str]) -> None:
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, "<u4").tobytes()

    def _together(self, new: list[str]) -> None:
        for k in range(0, len(new), 512):
            some = new[k : k + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids])
            if len(ends) != len(some):
                self._one_by_one(some)
                continue
            data, cuts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            self.words.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode_batch(self, many: list[str], end: tuple[int, ...]) -> list[np.ndarray]:
        plain = [_is_latin(x) and "<|" not in x for x in many]
        split = [_PIECE.findall(x.lower()) if p else x.encode("utf-8").split() for x, p in zip(many, plain, strict=True)]
        words = self.words
        if len(words) > WORDS:
            words.clear()
        new = [w for w in set().union(*split) if w not in words]
        self._together([w for w in new if isinstance(w, str)])
        for w in new:
            if isinstance(w, bytes):
                words[w] = np.array(self.tokenizer.encode(w.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        of, tail = words.__getitem__, np.array(end, "<u4").tobytes()
        return [np.frombuffer(b"".join(map(of, x)) + tail, "<u4") for x in split]


def word_tokens(path: str) -> WordTokens:
    return kept(("words", path), lambda: WordTokens(path))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: tuple[int, ...] = (2,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: where it starts, its length and checksum, the sequence it lies in and where there.

    A null text is empty and has the end ids only; each of repeated rows is a
    document; an empty table gives an empty result.  Sequences of different
    tasks have different ids: a task's number is in the upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, first_sequence=TaskContext.get().partitionId() << 36)
        own = word_tokens(path)

        def made() -> pa.RecordBatch:
            columns = zip(*packer.out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            packer.out.clear()
            return batch

        for ids, many in chunked(batches, "doc_id", "text", keep=True):
            for doc, tokens in zip(ids, own.encode_batch(many, end), strict=True):
                packer.add(doc, tokens)
            if packer.out:
                yield made()
        packer.finish()
        if packer.out:
            yield made()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
