"""Streams whose lexicon has any size and may be renewed while they run.

Versions of a lexicon are folders version=1, version=2, ... below one folder; a version
counts once it is written as a whole. Each batch of a stream is cut with the newest one,
by a broadcast of the lexicon or, beyond its limit, by joins, and is written to a folder
of its own. A batch that comes again after a failure is left alone where its folder is
whole and written anew where it isn't, so every line is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import segment as S
from ..storage import is_there, whole_versions


def publish(lexicon: DataFrame, folder: str) -> int:
    """Write (word, freq) as the next version and return its number. One job at a time may publish to a folder."""
    number = max(whole_versions(lexicon.sparkSession, folder), default=0) + 1
    # a folder of this number is what a job that was ended has left
    lexicon.select("word", F.col("freq").cast("bigint").alias("freq")).write.mode("overwrite").parquet(f"{folder}/version={number}")
    return number


class Newest:
    """The newest version of a lexicon; its model is kept until there is a newer one."""

    def __init__(self, lexicon: DataFrame | str):
        self.source = lexicon
        self.number: int | None = None
        self.model: S.Model | None = None

    def get(self, spark: SparkSession) -> tuple[int, S.Model]:
        """(number, model); a lexicon given as a table is number 0."""
        if isinstance(self.source, str):
            number = max(whole_versions(spark, self.source), default=None)
            if number is None:
                raise ValueError(f"no version of a lexicon in {self.source}")
        else:
            number = 0
        if number != self.number:
            if self.model is not None:
                self.model.release()
            frame = spark.read.parquet(f"{self.source}/version={number}") if number else self.source
            self.number, self.model = number, S.Model(frame)
        return self.number, self.model


def cut_batches(lines: DataFrame, lexicon: DataFrame | str, output: str, checkpoint: str, text_col: str = "value", form: str = "parquet", engine: str = "auto") -> DataStreamWriter:
    """A writer that cuts a stream with a lexicon (word, freq) or with the newest of the versions in a folder; start() runs it.

    Batch n goes to output/batch=n: the columns of lines with tokens and the version of the lexicon, as Parquet, or
    with form="text" lines of blank-separated words. Null texts have null tokens, texts without tokens an empty
    array; columns named tokens, version or batch are replaced.
    """
    newest = Newest(lexicon)
    kept = [c for c in lines.columns if c.lower() not in ("tokens", "version", "batch")]

    def write(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{output}/batch={number}"
        if is_there(spark, folder):
            return
        version, model = newest.get(spark)
        rows = batch.select(F.struct(*(F.col(f"`{c}`") for c in kept), F.col(text_col).isNull().alias("_null")).alias("_line"), F.col(text_col).alias("_text"))
        # a session keeps the files of every index, so versions that are too large for a broadcast are joined
        tokens = S.cut(rows, model, "_line", "_text", "native" if engine == "auto" and not model.small else engine)
        if form == "text":
            tokens.select(F.array_join("tokens", " ").alias("value")).write.mode("overwrite").text(folder)
            return
        cut = F.when(~F.col("_line._null"), F.col("tokens")).alias("tokens")
        tokens.select(*(F.col(f"_line.`{c}`") for c in kept), cut, F.lit(version).alias("version")).write.mode("overwrite").parquet(folder)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
