import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from arborlane.llm import packing
from arborlane.llm.bpe import vocabulary

from .cases import EDGE, edge, empty

PATH = vocabulary("word_bpe_49k.json")


def test_best_fill_is_closest():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randrange(4, 24)
        lengths = [rng.randrange(1, capacity + 4) for _ in range(rng.randrange(1, 9))]
        chosen = packing.best_fill(np.bincount(lengths, minlength=capacity + 1), capacity)
        fit = [x for x in lengths if x <= capacity]
        if not fit:
            assert chosen == {}
            continue
        first = max(fit)
        fit.remove(first)
        best = max(s for n in range(len(fit) + 1) for c in itertools.combinations(fit, n) if (s := first + sum(c)) <= capacity)
        assert sum(k * v for k, v in chosen.items()) == best
        assert all(lengths.count(k) >= v for k, v in chosen.items())


def verify(rows, ids_of, capacity):
    """Every id of every document lies in exactly one piece; sequences are gapless; only powers of two are short."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(ids_of)
    for d, pieces in docs.items():
        ids = ids_of[d]
        spans = sorted((p.start, p.length) for p in pieces)
        copies = sum(p.length for p in pieces) // len(ids)
        assert sum(n for _, n in spans) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        covered = np.zeros(len(ids), int)
        for s, n in spans:
            covered[s : s + n] += 1
        assert (covered == copies).all()
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity and at & (at - 1) == 0


@pytest.mark.parametrize("capacity,pool", [(16, 64), (4096, 1 << 20), (8, 8)])
def test_packer(capacity, pool):
    rng = random.Random(capacity)
    from types import SimpleNamespace as Row

    packer, ids_of = packing.Packer(capacity, pool), {}
    for d in range(300):
        ids_of[d] = np.arange(rng.choice([1, 3, capacity - 1, capacity, capacity * 2 + 3, rng.randrange(1, 3 * capacity)]), dtype="<u4") + d
        packer.add(d, ids_of[d])
    packer.finish()
    verify([Row(**dict(zip("doc_id start length ids_crc32 doc_tokens sequence_id offset".split(), x, strict=True))) for x in packer.out], ids_of, capacity)


def test_query_against_the_library(spark, sf):
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.query(spark, sf).collect()
    verify(rows, docs, packing.CAPACITY)
    assert len(rows) < len(docs) + sum(len(x) for x in docs.values()) // packing.CAPACITY + 40


def test_words_equal_the_library():
    library, own = Tokenizer.from_file(PATH), packing.WordTokens(PATH)
    many = ["", "ΑΣ ΑΣΑ  İstanbul", "e ́ x́", "it's  <|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85e", "ﬁ 12 3!!\n\n?"]
    rng = random.Random(4)
    alphabet = [chr(k) for k in range(256)] + list("'stlrevmd ") * 20
    many += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(300)]
    for text, ids in zip(many, own.encode_batch(many, ()), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_edge_rows(spark):
    library = Tokenizer.from_file(PATH)
    verify(packing.pack(edge(spark), PATH).collect(), {d: [*library.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in EDGE}, 4096)
    assert packing.pack(empty(spark), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(100)
