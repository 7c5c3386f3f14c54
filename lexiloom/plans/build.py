"""From articles and word lists to a trained lexicon, stage by stage; a stage whose table is there isn't run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..sources import files
from ..storage import is_there
from .train import LEAST, SUB_ITERATIONS, VOCABULARY, train


def build_lexicon(spark: SparkSession, articles: DataFrame, words: DataFrame, folder: str, vocabulary: int = VOCABULARY, sub_iterations: int = SUB_ITERATIONS, least: int = LEAST) -> DataFrame:
    """(word, freq) of the lexicon trained on the articles' sentences, from candidate words.

    Stages: sentences, character counts, the words whose characters are common
    enough, and training with a journal of its rounds. Each is stored as Parquet below
    folder; a run that was ended goes on where it stopped.
    """

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        if not is_there(spark, path):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    sentences = stage("sentences", lambda: files.split_sentences(files.process_articles(articles).select("text")).select(F.col("sentence").alias("text")))
    counts = stage("char_counts", lambda: L.char_counts(sentences))
    seed = stage("seed", lambda: L.add_single_chars(L.filter_by_chars(words, counts, least), counts))
    return stage("lexicon", lambda: train(sentences, seed, vocabulary, sub_iterations, least, journal=f"{folder}/journal"))
