"""The pipeline stage by stage against brute force."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from arborlane.llm import quality, resampling, secrets
from arborlane.llm.bpe import vocabulary

from .cases import edge, empty
from .test_packing import verify
from .test_simhash import shingles


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's input and result, written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(folder / name))
        result = spark.read.parquet(str(folder / name))
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages, spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "secret_scan", "packing"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(result.columns == columns for name, (_, result) in stages.items() if name != "packing")


def test_classifier_and_rules_keep_what_their_operators_select(stages, spark, sf):
    docs, result = stages["quality_classifier"]
    want = {r.doc_id for r in resampling.sample(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert set(rows(result)) == want
    docs, result = stages["quality_rules"]
    assert set(rows(result)) == {r.doc_id for r in quality.rules(docs).where("kept").collect()}


def test_good_documents_stay(stages, spark, sf):
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    for name in ("quality_classifier", "quality_rules"):
        docs, result = stages[name]
        before = good & {d for d, r in rows(docs).items() if name == "quality_classifier" or len(r.text.split()) >= 20}
        assert len(before & set(rows(result))) >= 0.99 * len(before)


def test_dedup_leaves_one_of_each_group(stages):
    docs, result = (rows(x) for x in stages["simhash_near_dedup"])
    sets = {d: shingles(r.text) for d, r in docs.items()}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = sorted(result)
    assert not [(a, b) for i, a in enumerate(kept) for b in kept[:i] if jaccard(a, b) >= 0.85]
    for d in set(docs) - set(kept):
        assert max(jaccard(d, x) for x in docs if x != d) >= 0.7
        assert docs[min(docs)].doc_id in result


def test_secrets_are_masked_and_nothing_else(stages):
    docs, result = stages["secret_scan"]
    found = rows(secrets.scan(docs))
    before, after = rows(docs), rows(result)
    assert set(before) == set(after)
    for d, r in before.items():
        if found[d].n_live == 0:
            assert after[d].text == r.text
        else:
            assert after[d].text.count(secrets.REPLACEMENT) >= 1 and after[d].n_chars == len(after[d].text)
            copied = found[d].n_copied
            assert len(secrets.base_spans(after[d].text)) <= copied


def test_packing_covers_every_token(stages):
    docs, result = stages["packing"]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    verify(result.collect(), {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}, 4096)


def test_run_gives_the_stages_result(stages, spark, sf):
    def pieces(df):
        return sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())

    assert pieces(corpus_pipeline.run(spark, sf)) == pieces(stages["packing"][1])


@pytest.mark.parametrize("make", [edge, empty])
def test_edge_rows_pass_all_stages(spark, tmp_path, make):
    make(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("length") <= 0).count() == 0
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
