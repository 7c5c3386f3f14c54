"""Rows with one doc_id and different texts, in the pipeline."""

import random

import corpus_pipeline
from lexiloom.llm import quality

from . import brute


def test_rows_with_one_id_are_told_apart(spark):
    rng = random.Random(3)
    one, two, clean = (" ".join(f"word{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    rows = [(1, two, "en", "s", 0), (2, one, "en", "s", 0), (2, two, "en", "s", 0)]
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, docs.schema), brute.SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, two), (2, one)])
    item = max((r.text for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()), key=lambda x: len(x or ""))
    rows = [(5, clean, "en", "s", 0), (5, f"{one} {item}", "en", "s", 0), (None, clean, "en", "s", 0)]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, docs.schema), brute.SF).collect()
    assert [(r.doc_id, r.text) for r in kept if r.doc_id] == [(5, clean)] and len(kept) == 2


def test_the_same_text_of_an_id_is_learned_from_in_any_order(spark):
    rng = random.Random(4)
    rows = [(k % 40, " ".join(rng.choice(["good", "bad", "plain", "odd", f"w{rng.randrange(99)}"]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    rows += [(k, t) for k in range(10) for t in (None, "")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    fitted = []
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        fitted.append(quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels).tobytes())
    assert len(set(fitted)) == 1
    one = spark.createDataFrame([(1, "good text"), (1, None), (1, "")], "doc_id long, text string")
    alone = quality.fit(one.where("text = 'good text'"), labels)
    assert quality.fit(one, labels).tobytes() == alone.tobytes() and alone.any()
