"""Readers and writers of the text formats; every reader has a fixed schema."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.convert import converted


def lexicon_rows(lines: DataFrame) -> DataFrame:
    """(word, freq) from lines "word TAB freq": lines without a TAB and empty words are skipped.

    What follows a leading integer is ignored; no integer of 64 bits behind the TAB raises.
    """
    rest = F.expr("substr(value, instr(value, '\t') + 1)")
    number = F.regexp_extract(rest, r"^\s*([+-]?\d+)", 1)
    wrong = F.raise_error(F.concat(F.lit("no frequency in lexicon line: "), "value")).cast("bigint")
    return lines.where("instr(value, '\t') > 1").select(F.expr("substr(value, 1, instr(value, '\t') - 1)").alias("word"), F.coalesce(number.try_cast("bigint"), wrong).alias("freq"))


def word_rows(lines: DataFrame) -> DataFrame:
    """Words: what stands before the first TAB, else before the first blank, else the line."""
    word = F.expr("case when instr(value, '\t') > 0 then split_part(value, '\t', 1) when instr(value, ' ') > 0 then split_part(value, ' ', 1) else value end")
    return lines.select(word.alias("word")).where("word <> ''")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A missing file raises."""
    return lexicon_rows(spark.read.text(path))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return word_rows(spark.read.text(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One text per line; empty lines stay. Invalid UTF-8 is repaired on entry."""
    return spark.read.text(path).select(F.make_valid_utf8("value").alias("text"))


def concat_corpora(*corpora: DataFrame) -> DataFrame:
    """The corpora one behind the other: their rows with source_no, the number of the corpus from 0."""
    numbered = [c.select(F.lit(k).alias("source_no"), *c.columns) for k, c in enumerate(corpora)]
    return reduce(DataFrame.unionByName, numbered)


def counted(rows: DataFrame, name: str, *more: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation whose get["rows"] tells how many passed once an action has run; more: other aggregates to tell."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def article_rows(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(title, text) of JSON lines; blank lines and articles without text are skipped."""
    return lines.select(F.from_json(line_col, "title string, text string").alias("a")).select("a.title", "a.text").where("text is not null and text <> ''")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with title and text; blank lines and articles without text are skipped."""
    rows = spark.read.schema("title string, text string").json(path)
    return rows.where("text is not null and text <> ''")


def conversion_rows(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(source, target) from lines "source TAB target target ...": the first target counts. Lines without a TAB or with an empty side are skipped."""
    parts = lines.select(F.split(line_col, "\t", 2).alias("p")).where(F.size("p") == 2)
    pairs = parts.select(F.get("p", F.lit(0)).alias("source"), F.get(F.split(F.get("p", F.lit(1)), " "), F.lit(0)).alias("target"))
    return pairs.where("source <> '' and target <> ''")


def read_conversion(spark: SparkSession, path: str) -> DataFrame:
    return conversion_rows(spark.read.text(path))


def process_articles(articles: DataFrame, mapping=None, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """Cleaned article texts, converted by mapping and tables, without empty ones."""
    return converted(articles.withColumn("text", T.clean_text(F.col("text"))), "text", mapping, tables).where("text <> ''")


def split_sentences(articles: DataFrame, text_col: str = "text") -> DataFrame:
    """One sentence a row, with its number inside the article."""
    return articles.select(*[c for c in articles.columns if c != text_col], F.posexplode(T.sentences(F.col(text_col))).alias("sent_no", "sentence"))


def write_tokens(segmented: DataFrame, path: str, tokens_col: str = "tokens") -> None:
    """Tokens joined by blanks, one line a row; an empty text gives an empty line."""
    segmented.select(F.array_join(tokens_col, " ").alias("value")).write.text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    counts.orderBy("word").select("word", "freq").write.csv(path, sep="\t", quote="")


def write_losses(losses: DataFrame, path: str) -> None:
    losses.orderBy(F.desc("loss"), "word").select("word", "loss", "cnt").write.csv(path, sep="\t", quote="")
