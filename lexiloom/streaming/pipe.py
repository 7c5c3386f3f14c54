"""Stateless segmentation and running counts over streams of text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions import text as T
from ..operators.segment import cut_udf


def cut_stream(lines: DataFrame, lexicon: DataFrame, text_col: str = "value") -> DataFrame:
    """lines with a tokens column; works on streams and on batches."""
    return lines.withColumn("tokens", cut_udf(lines.sparkSession, lexicon)(F.col(text_col)))


def cut_to_lines(lines: DataFrame, lexicon: DataFrame, text_col: str = "value") -> DataFrame:
    """One line of blank-separated words per line."""
    return cut_stream(lines, lexicon, text_col).select(F.array_join("tokens", " ").alias("value"))


def running_counts(segmented: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """An extension: word counts of all that has come, for output modes complete and update."""
    return segmented.select(F.explode(tokens_col).alias("word")).where(T.is_valid_word(F.col("word"))).groupBy("word").agg(F.count("*").alias("freq"))


#: The name under which a stream's batches are counted.
COUNTED = "lexiloom_counted"


def counted_stream(segmented: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """segmented, whose batches tell Progress how many lines and words they have."""
    return segmented.observe(COUNTED, F.count(F.lit(1)).alias("lines"), F.sum(F.greatest(F.size(tokens_col), F.lit(0))).alias("words"))


class Progress(StreamingQueryListener):
    """Adds up the lines and words of counted streams and tells them after each batch: spark.streams.addListener(Progress(print))."""

    def __init__(self, tell=None):
        self.lines = self.words = self.batches = 0
        self.tell = tell

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(COUNTED)
        if row is not None and row["lines"]:
            self.batches += 1
            self.lines += row["lines"]
            self.words += row["words"] or 0
            if self.tell:
                self.tell(f"{self.lines} lines, {self.words} words")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
