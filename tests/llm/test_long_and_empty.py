"""Very long texts, empty tables, and columns whose names clash, in the operators and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import decontaminate, langid, licenses, packing, passagededup, quality, queries, simhash, suffixdedup

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(90000)}" for _ in range(n))


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(8)
    passage = sentence(rng, 80)
    giant = f"{sentence(rng, 300_000)} {passage} {licenses.TEMPLATES['Apache-2.0-text']} {sentence(rng, 200_000)}"
    assert len(giant) > 3_500_000
    return passage, [(1, giant, "en", "s", 0), (2, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}", "en", "s", 0), (3, giant, "en", "s", 0), (4, sentence(rng, 300), "en", "s", 0)]


def test_long_texts(spark, long_texts):
    passage, rows = long_texts
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([(1, " ".join(passage.split()[20:40]))], "item_id long, text string")
    found = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, benchmark).collect()}
    assert found == {1: 20, 2: 20, 3: 20, 4: 0}
    assert sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs.where("doc_id < 3")).collect()) == [(1, "Apache-2.0-text")]
    near = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert near == {d: (f, c) for d, f, c in brute.near([r[:2] for r in rows])} and near[3][1] == 1
    got = {r.doc_id: r for r in passagededup.dedup_passages(docs).collect()}
    assert {got[k].class_id for k in (1, 2, 3)} == {1} and got[4].class_id == 4 and got[2].n_near == 80
    assert sorted(got[k].n_removed for k in (1, 3)) == [0, got[1].n_words] or got[2].n_removed == 0
    cut = {r.doc_id: r for r in suffixdedup.remove_repeated_substrings(docs).collect()}
    assert cut[1].n_removed == cut[1].n_bytes == cut[3].n_removed and 400 <= cut[2].n_removed <= len(passage) + 2 and cut[4].n_removed == 0
    assert {r.doc_id: r.lang_pred for r in langid.predict_languages(docs.select("doc_id", "text"), docs.where("doc_id > 1").select("text", "lang")).collect()} == dict.fromkeys((1, 2, 3, 4), "en")


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0
    assert quality.score_quality(empty, labels).count() == 0
    one = spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)
    assert quality.score_quality(one, labels).count() == 1
    assert passagededup.dedup_passages(empty).count() == 0 and passagededup.remove_passages(empty).count() == 0
    assert licenses.scan_licenses(one, {}).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_whose_names_clash(spark):
    rng = random.Random(2)
    names = ("key", "_key", "digest", "null", "score", "letters", "lang_pred", "seg", "row", "carried", "text.x")
    docs = spark.createDataFrame([(k, sentence(rng, 60), "en", "s", 0) for k in (1, 2, 2)] + [(None, sentence(rng, 60), "en", "s", 0)], DOCS)
    docs = docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, brute.SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == 4, name
        assert {tuple(r[n] for n in names) for r in rows} == {tuple(f"own {n}" for n in names)}, name
