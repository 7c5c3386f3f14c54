"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept. run() writes every stage's result as Parquet into the shared
checkpoint folder and reads it again for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, langid, packing, passagededup, simhash
from lexiloom.llm.queries import tokenizer_path
from lexiloom.llm.store import free_name, shared_folder, table

#: A text of so many letters that is still not like any learned language is rejected.
LETTERS, SCORE = 200, 0.53


def _key():
    """doc_id, or for rows without one a number from the text, above all ids."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, and long texts unlike every learned language. Short texts in doubt stay."""
    labelled = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out("doc_id", 3, 1)).select("text", "lang")
    # the other columns go along as one, so none is taken for a result
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), "text")
    seen = langid.predict_languages(rows, labelled, keep_text=True)
    rejected = (F.col("lang_pred") == langid.UNKNOWN) | ((F.col("letters") >= LETTERS) & (F.col("score") < SCORE))
    return seen.where(~rejected).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, once."""
    key, digest = free_name(docs, "key"), free_name(docs, "digest")
    keyed = docs.withColumn(key, _key()).withColumn(digest, F.xxhash64("text"))
    near = simhash.near_duplicates(keyed, id_col=key, carry=(digest,))
    # rows with one doc_id and different texts may be of different groups
    first = near.where("doc_id = component_id").select(F.col("doc_id").alias(key), digest).distinct()
    kept = keyed.join(first, [key, digest], "left_semi")
    return kept.dropDuplicates([key, digest]).select(*(F.col(f"`{c}`") for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes near-duplicate passages of 50 words or more from all but the first document that has them."""
    cut = passagededup.remove_passages(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64(_key(), "text"))
    found = decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(found.where("contaminated").select(F.col("doc_id").alias(key)), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, passages and token ids are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
