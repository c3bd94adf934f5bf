"""Operator 10, BPE encoding and decoding by tree concatenation.

A long text is halved, down to leaves; the leaves of all texts at hand are
encoded together; then, level by level, two neighbours are joined: a window of
tokens around the seam is encoded anew and grows until its outer tokens agree
with both sides, which makes the joined tokens exactly those of the whole.
The halves of a text of over `LONG` code points, down to that size, are rows that
go to several tasks; the seams between them are joined where the text's tokens
come together.

Why agreement is enough: a sequence of byte-pair tokens is the encoding of its
text if and only if each adjacent pair is the encoding of its own text.  Inside
the sides and inside the window all pairs are right; at the window's two edges
the pair is unchanged, because the outer tokens agree.  The pattern that splits
text before the merges never matches across a boundary between a character and
white space after it, and runs that a window cuts end where the whole's do; so
a window must also hold such a boundary within its agreeing edges, or agree
over many tokens, or reach the text's end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, kept, read, scan_partitions, texts

#: Code points of a leaf; tokens on each side of the first window; tokens that must agree, without and with a sure boundary.
LEAF, WINDOW, AGREE, SURE = 2048, 8, 16, 2
#: Code points from which on a text's halves are encoded by several tasks.
LONG = 1 << 16
#: Units (a word with the white space before it) whose tokens a worker keeps.
UNITS = 300_000
#: White space of the splitting pattern.
_S = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNIT = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")
#: A sure boundary in bytes: a printable character, then white space.
_SURE = re.compile(rb"[!-~][ \n]")
#: How marks of the vocabulary's own begin; units that may hold one are encoded apart.
_MARK = "<|"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def halves(text: str, most: int) -> list[str]:
    """The text's halves, quarters and so on, none of over `most` code points."""
    count = 1
    while len(text) > count * most:
        count *= 2
    cut = [len(text) * k // count for k in range(count + 1)]
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)]


class TreeEncoder:
    """Encodes and decodes as the tokenizers library does with this byte-level vocabulary file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window = max(1, leaf), max(1, window)
        chars, added = _byte_of_char(), {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[k] = added[k].encode() if k in added else bytes(chars[c] for c in token)
        self.text_of = [str(k) for k in range(len(self.bytes_of))]
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.units: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        """Encodes units.  Those from white space to no white space stay apart in one text, too: their tokens are told apart by their bytes."""
        apart = [u for u in new if u[0] in _S and u[-1] not in _S and _MARK not in u]
        for k in range(0, len(apart), 256):
            some = apart[k : k + 256]
            ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(u.encode()) for u in some])) + 1
            data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.units.update(zip(some, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        rest = [u for u in new if u not in self.units]
        for u, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.units[u] = np.array(e.ids, "<u4").tobytes()

    def leaves(self, many: list[str]) -> list[np.ndarray]:
        """Each text's tokens.  Texts split into units at sure boundaries; each unit is encoded by the library once."""
        split = [_UNIT.findall(x) for x in many]
        if len(self.units) > UNITS:
            self.units.clear()
        if new := [u for u in set().union(*split) if u not in self.units]:
            self._learn(new)
        of = self.units.__getitem__
        return [np.frombuffer(b"".join(map(of, x)), "<u4") for x in split]

    def _edge(self, ids: np.ndarray, w: int, left: bool) -> tuple[int, bytes, bool, bool]:
        """Of a side's w tokens next to the seam: how many to take, so that no character is cut; their bytes; whether that is the whole side; whether their outer part has a sure boundary."""
        while w < len(ids) and (self.bytes_of[ids[len(ids) - w if left else w]][:1] or b" ")[0] & 0xC0 == 0x80:
            w += 1
        w = min(w, len(ids))
        some = [self.bytes_of[k] for k in (ids[len(ids) - w :] if left else ids[:w]).tolist()]
        outer = b"".join(some[: w // 2] if left else some[w - w // 2 :])
        return w, b"".join(some), w == len(ids), bool(_SURE.search(outer))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens of both sides' text together."""
        if not len(left) or not len(right):
            return left if len(left) else right
        w = self.window
        while True:
            a, before, all_left, sure_left = self._edge(left, w, True)
            b, after, all_right, sure_right = self._edge(right, w, False)
            ids = self.leaves([(before + after).decode("utf-8")])[0]
            na, nb = max(SURE, a // 2) if sure_left else AGREE, max(SURE, b // 2) if sure_right else AGREE
            left_ok = all_left or (a >= na and np.array_equal(ids[:na], left[len(left) - a :][:na]))
            right_ok = all_right or (b >= nb and np.array_equal(ids[max(0, len(ids) - nb) :], right[b - nb : b]))
            if left_ok and right_ok:
                return np.concatenate([left[: len(left) - a], ids, right[b:]])
            w *= 2

    def joined(self, level: list[np.ndarray]) -> np.ndarray:
        """The tokens of the text whose halves, quarters and so on have these."""
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) for k in range(0, len(level), 2)]
        return level[0]

    def encode_batch(self, many: list[str]) -> list[np.ndarray]:
        parts = [halves(x, self.leaf) for x in many]
        flat = iter(self.leaves([p for x in parts for p in x]))
        return [self.joined([next(flat) for _ in x]) for x in parts]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    return kept(("bytes", path, leaf), lambda: TreeEncoder(path, leaf))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoded(rows: DataFrame, path: str, leaf: int, long: int, made, ddl: str) -> DataFrame:
    """made(encoder, ids, tokens of each) of all rows (doc_id, text), in batches of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for ids, many in chunked(batches, "doc_id", "text", keep=True):
            yield made(own, ids, own.encode_batch(many))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, copies, many in chunked(batches, "doc_id", "digest", "copies", "text"):
            for i, digest, n, text in zip(ids, digests, copies, many, strict=True):
                parts = halves(text, long)
                same = lambda x, kind, size=len(parts): pa.array([x] * size, kind)
                yield pa.RecordBatch.from_arrays([same(i, pa.int64()), same(digest, pa.string()), same(n, pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.string())], ["doc_id", "digest", "copies", "part", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, leaf)
        for ids, digests, copies, part, many in chunked(batches, "doc_id", "digest", "copies", "part", "text", keep=True):
            tokens = [x.astype("<u4").tobytes() for x in own.encode_batch(many)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(copies, pa.int64()), pa.array(part, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "digest", "copies", "part", "tokens"])

    def whole(one: pa.Table) -> pa.Table:
        own, one = encoder(path, leaf), one.sort_by("part")
        tokens = own.joined([np.frombuffer(x, "<u4") for x in one["tokens"].to_pylist()])
        batch = made(own, [one["doc_id"][0].as_py()], [tokens])
        return pa.Table.from_batches([batch] * one["copies"][0].as_py())

    short = rows.where(F.length("text") <= long).mapInArrow(run, ddl)
    longer = rows.where(F.length("text") > long).groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    dealt = longer.mapInArrow(cut, "doc_id long, digest string, copies long, part long, text string").repartition(2 * scan_partitions(rows), "doc_id", "digest", "part")
    parts = dealt.mapInArrow(each, "doc_id long, digest string, copies long, part long, tokens binary")
    return short.union(parts.groupBy("doc_id", "digest").applyInArrow(whole, ddl))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every row; a null text is empty and has no ids, each of repeated rows gives a row, an empty table gives an empty result."""

    def made(own: TreeEncoder, ids: list, many: list[np.ndarray]) -> pa.RecordBatch:
        tokens = [x.tolist() for x in many]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array([own.decode(x) for x in tokens], pa.string())], ["doc_id", "ids", "decoded"])

    return _encoded(texts(docs, id_col, text_col), path, leaf, long, made, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """Like `encode`, for nulls, empty texts, repeated rows and empty tables too, with digests in place of ids and decoded text."""

    def made(own: TreeEncoder, ids: list, many: list[np.ndarray]) -> pa.RecordBatch:
        name, tokens = own.text_of.__getitem__, [x.tolist() for x in many]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in tokens], pa.int64()), pa.array([sha(",".join(map(name, x))) for x in tokens], pa.string()), pa.array([sha(own.decode(x)) for x in tokens], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(texts(docs, id_col, text_col), path, leaf, long, made, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
