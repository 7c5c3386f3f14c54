"""Unsupervised training: estimate word frequencies by cutting and recounting, and prune by loss."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import segment as S
from ..operators.lexicon import keep_by_loss
from ..storage import is_there, materialise

# The defaults of training.
VOCABULARY, SUB_ITERATIONS, LEAST = 180_000, 2, 15


def em_step(chunks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Cut with the lexicon and recount its words; words that no best path has vanish."""
    return S.token_counts(chunks, lexicon, only_lexicon=True)


def prune_step(chunks: DataFrame, lexicon: DataFrame, vocabulary: int, least: int, store: Callable = materialise) -> DataFrame:
    kept = keep_by_loss(store(S.word_loss(chunks, lexicon)), lexicon, vocabulary, least)
    return lexicon.join(kept, "word", "left_semi")


class Journal:
    """The tables of a training run, one after the other: in a folder, where a later run finds them, or else checkpointed.

    A run that was ended goes on behind the last table that it wrote. Runs with other
    parameters don't share a folder.
    """

    def __init__(self, corpus: DataFrame, folder: str | None, **parameters: int):
        self.spark, self.folder = corpus.sparkSession, folder
        if folder:
            given = self.spark.createDataFrame([(k, v) for k, v in sorted(parameters.items())], "name string, value bigint")
            have = {r["name"]: r["value"] for r in self.table("parameters", lambda: given).collect()}
            if have != parameters:
                raise ValueError(f"{folder} holds a training run with other parameters: {have}")

    def table(self, name: str, make: Callable[[], DataFrame], seen: Observation | None = None, report: Callable[[dict], None] | None = None) -> DataFrame:
        """The table of that name, made if it isn't there. report gets what seen has observed where it is made."""
        if not self.folder:
            out, made = materialise(make()), True
        else:
            path = f"{self.folder}/{name}"
            made = not is_there(self.spark, path)
            if made:
                make().write.mode("overwrite").parquet(path)
            out = self.spark.read.parquet(path)
        if made and seen and report:
            report(seen.get)
        return out


def train(
    corpus: DataFrame,
    lexicon: DataFrame,
    vocabulary: int = VOCABULARY,
    sub_iterations: int = SUB_ITERATIONS,
    least: int = LEAST,
    text_col: str = "text",
    max_rounds: int = 100,
    on_round=None,
    journal: str | None = None,
    on_counts: Callable[[int, dict], None] | None = None,
) -> DataFrame:
    """(word, freq) of the trained lexicon.

    The corpus is read twice: for the longest-match counts that start the training
    and for its distinct chunks, which all rounds share. Rounds go on while the
    lexicon is larger than the vocabulary; a round that removes nothing ends them.
    on_round(round, lexicon) may keep each round's lexicon. journal is a folder in
    which every table of the run is kept, so a run that was ended goes on there.
    on_counts(round, counters) gets the words, the tokens on the best paths and the
    total loss of each round as soon as they are known, then the words kept and
    dropped.
    """
    held = Journal(corpus, journal, vocabulary=vocabulary, sub_iterations=sub_iterations, least=least)
    current = held.table("start", lambda: S.match_counts(corpus, lexicon, text_col))
    chunks = held.table("chunks", lambda: S.chunk_counts(corpus, text_col))
    size, rounds = current.count(), 0
    tell = on_counts or (lambda *_: None)

    def estimated(name: str, words: DataFrame) -> DataFrame:
        for k in range(sub_iterations):
            words = held.table(f"{name}-em-{k}", lambda words=words: em_step(chunks, words))
        return words

    while size > vocabulary and rounds < max_rounds:
        rounds += 1
        before = estimated(f"round-{rounds}", current)
        seen = Observation(f"round {rounds}")

        def losses(rows: DataFrame, seen=seen, number=rounds) -> DataFrame:
            counters = (F.count(F.lit(1)).alias("words"), F.sum("cnt").alias("tokens"), F.sum(F.col("loss")).alias("loss"))
            return held.table(f"round-{number}-loss", lambda: rows.observe(seen, *counters), seen, lambda counts: tell(number, counts))

        current = held.table(f"round-{rounds}-kept", lambda before=before, losses=losses: prune_step(chunks, before, vocabulary, least, losses))
        if on_round:
            on_round(rounds, current)
        last, size = size, current.count()
        if on_counts:
            tell(rounds, {"kept": size, "dropped": before.count() - size})
        if size == last:
            break
    return estimated("final", current)
