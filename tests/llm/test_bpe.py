import hashlib
import random

import pytest
from tokenizers import Tokenizer

from arborlane.llm import bpe

from .cases import EDGE, edge, empty

PATH = bpe.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    kinds = ["ab", "aab ", "'stdm x", "!?'s.", " \n\t", "é日ß𝄞a", "0123 ", "abcdefghij klmnop  \x1c\x85"]
    for k in range(200):
        yield "".join(rng.choice(kinds[k % len(kinds)]) for _ in range(rng.randrange(0, 400)))
    yield "<|endoftext|> a<|endoftext|>b  <|endoftext|>"
    yield "word" * 3000
    yield "".join(rng.choice("acgt") for _ in range(5000))
    yield "''" * 700 + "s" * 500 + " '" * 600
    yield "不" * 3000


@pytest.mark.parametrize("leaf", [1, 7, 64, 2048])
def test_equals_the_library(library, leaf):
    own = bpe.TreeEncoder(PATH, leaf, window=2 if leaf < 64 else 8)
    many = list(texts())[:: 3 if leaf == 1 else 1]
    for text, ids in zip(many, own.encode_batch(many), strict=True):
        ids = ids.tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_decodes_cut_characters_like_the_library(library):
    own = bpe.TreeEncoder(PATH)
    ids = library.encode("日本語", add_special_tokens=False).ids
    for k in range(len(ids)):
        for part in (ids[k:], ids[:k]):
            assert own.decode(part) == library.decode(part, skip_special_tokens=False)


def test_edge_rows(spark, library):
    rows = bpe.digests(edge(spark), PATH).collect()
    want = sorted((d or -1, hashlib.sha256((t or "").encode()).hexdigest(), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in EDGE)
    assert sorted((r.doc_id or -1, r.decoded_sha256, r.n_tokens) for r in rows) == want
    assert bpe.digests(empty(spark), PATH).count() == 0


def test_query_equals_the_library_on_whole_texts(spark, sf, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_halves_of_long_texts_go_to_several_tasks(spark, library):
    """Texts of over 50 code points are cut for several tasks; repeated rows, null ids and extra columns too."""
    many = [*list(texts())[::2], "word " * 200, "word " * 200, "é日本 x" * 99, None, ""]
    rows = [(None if k % 5 == 4 else k // 2, t, "x") for k, t in enumerate(many)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode(df, PATH, leaf=16, long=50).collect()), key=str)
    assert got == sorted(((d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t, _ in rows), key=str)
    short = sorted(map(tuple, bpe.digests(df, PATH).collect()), key=str)
    assert short == sorted(map(tuple, bpe.digests(df, PATH, long=50).collect()), key=str)
