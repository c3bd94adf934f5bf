import itertools

import numpy as np
import pytest

from arborlane.llm import language as lg

from .cases import EDGE, edge, empty


@pytest.fixture(scope="module")
def model(spark):
    rows = [("the house and the garden with other things", "en"), ("das Haus und der Garten mit anderen Dingen", "de"), ("la maison et le jardin avec les autres choses", "fr"), ("дом и сад и другие вещи", "ru"), ("ignored", None)] * 5
    return lg.train(spark.createDataFrame(rows, "text string, lang string"))


def test_learns_languages_and_scripts(model):
    assert model.languages == ["de", "en", "fr", "ru"]
    assert [model.scripts[3, lg.SCRIPTS.index(s)] for s in ("Cyrillic", "Latin")] == [True, False]
    assert np.allclose(np.exp(model.table.astype(float)).sum(axis=2), 1, atol=1e-3)


def test_best_path_equals_all_paths(model):
    many = ["the house und der garten", "дом the и", "12 -- !!", "", "maison", "la maison and the house et le 日本"]
    chunk = lg.Chunk(many)
    score, label = model.word_scores(chunk), model.label(chunk)
    begin = np.concatenate([[0], np.cumsum(chunk.words.n_words)])
    for d in range(len(many)):
        e = score[begin[d] : begin[d + 1]]
        value = lambda path: sum(e[i, s] for i, s in enumerate(path)) - model.switch * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: E731, B023
        best = max((value(p) for p in itertools.product(range(4), repeat=len(e))), default=0)
        assert np.isclose(value(label[begin[d] : begin[d + 1]]), best)


def test_spans_of_mixed_text(model):
    text = "the house and the garden with other things дом и сад и другие вещи das Haus und der Garten mit anderen Dingen"
    langs, scores, spans = model.predict([text, "!!! 123", "the house"])
    assert [s["lang"] for s in spans[0]] == ["en", "ru", "de"] and [(s["start"], s["end"]) for s in spans[0]] == [(0, 8), (8, 14), (14, 22)]
    assert langs[1:] == ["und", "en"] and scores[1:] == [0.0, 1.0] and spans[1] == []
    assert 0 < scores[0] < 1


def test_unknown_script_still_gets_a_learned_language(model):
    assert model.predict(["日本語"])[0][0] in model.languages


def test_edge_rows(spark, model):
    rows = lg.identify(edge(spark), model).collect()
    assert len(rows) == len(EDGE)
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert lg.identify(empty(spark), model).count() == 0
    nothing = lg.train(empty(spark))
    assert {r.lang_pred for r in lg.identify(edge(spark), nothing).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = lg.query(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_predictions_do_not_see_lang_or_source(spark, model):
    from pyspark.sql import functions as F

    plain = edge(spark)
    other = plain.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    read = lambda df: sorted((str(r.doc_id), r.lang_pred, r.score) for r in lg.identify(df, model).collect())
    assert read(plain) == read(other)


def test_scripts_narrow_before_words_are_scored(model):
    """A Cyrillic word has scores in Cyrillic's languages alone, whatever n-grams say; one without letters or of an unknown script in all."""
    chunk = lg.Chunk(["дом house 12 日本語"])
    score = model.word_scores(chunk)
    cyrillic = model.scripts[:, lg.SCRIPTS.index("Cyrillic")]
    assert np.isfinite(score[0]).tolist() == cyrillic.tolist() and np.isfinite(score[1]).tolist() == (~cyrillic).tolist()
    assert (score[2] == 0).all() and np.isfinite(score[3]).all()
    places = [chunk.places(n)[0] for n in lg.SIZES]
    brute = sum(float(model.table[1, k, places[k][at]]) for k in range(len(lg.SIZES)) for at in range(chunk.words.start[1], chunk.words.end[1] + 1)) / len(lg.SIZES)
    assert np.isclose(score[1, 1], brute)


def test_query_shows_spans(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in lg.query(spark, sf).collect():
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert len(spans) == r.n_spans and [int(a) for a, *_ in spans[1:]] == [int(b) for _, b, _ in spans[:-1]]
        assert not spans or (int(spans[0][0]), int(spans[-1][1])) == (0, len(docs[r.doc_id].encode().split()))


def test_refuses_too_many_languages(spark):
    with pytest.raises(ValueError):
        lg.train(spark.createDataFrame([("word", f"l{k}") for k in range(lg.MOST_LANGUAGES + 1)], "text string, lang string"))
