"""Building and filtering lexicons: set operations, filters, joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions import text as T
from ..functions.convert import converted
from ..functions.spans import letters_counted, substrings_counted
from .select import best_k


def pure_words(words: DataFrame, longest: int, word_col: str = "word") -> DataFrame:
    """Distinct stripped words of lexicon characters only, up to a length."""
    word = T.strip(F.col(word_col))
    return words.select(word_col).distinct().select(word.alias("word")).where(T.is_pure(F.col("word")) & (F.char_length("word") <= longest)).distinct()


def title_words(titles: DataFrame, title_col: str = "word") -> DataFrame:
    """Titles of up to three characters; of titles with middle dots the parts of up to four."""
    parts = titles.select(title_col).distinct().select(F.explode(F.split(T.strip(F.col(title_col)), "·")).alias("word"), F.col(title_col).contains("·").alias("dotted"))
    return parts.where(T.is_pure(F.col("word")) & (F.char_length("word") <= F.when(F.col("dotted"), 4).otherwise(3))).select("word").distinct()


def redirect_words(pairs: DataFrame) -> DataFrame:
    """Both sides of redirect pairs, up to three characters."""
    return pure_words(pairs.select(F.explode(F.array("source", "target")).alias("word")), 3)


def union_words(*sources: DataFrame | None) -> DataFrame:
    """Distinct words of all sources; a source that is None is skipped."""
    return reduce(DataFrame.unionByName, [s.select("word") for s in sources if s is not None]).distinct()


def with_constituents(words: DataFrame) -> DataFrame:
    """words and every character of their words of several characters."""
    chars = words.where(F.char_length("word") > 1).select(F.explode(T.split_chars(F.col("word"))).alias("word"))
    return words.select("word").unionByName(chars).distinct()


def good_titles(titles: DataFrame, title_col: str = "title", mapping=None, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """Titles to take words from, converted by mapping and tables first, without those that only continue an accepted shorter one.

    Over sorted titles, "starts with the last accepted title of four characters or
    more" is the same as "some good title is a proper prefix of four characters or
    more": what it starts with was accepted, or was itself suppressed by a prefix.
    """
    good = converted(titles.select(title_col).distinct().select(T.strip(F.col(title_col)).alias("title")), "title", mapping, tables).where(T.is_good_title(F.col("title"))).distinct()
    prefixes = good.where(F.char_length("title") > 4).select("title", F.explode(F.transform(F.sequence(F.lit(4), F.char_length("title") - 1), lambda n: F.substring("title", F.lit(1), n))).alias("prefix"))
    covered = prefixes.join(good.select(F.col("title").alias("prefix")), "prefix", "left_semi").select("title").distinct()
    return good.join(covered, "title", "left_anti")


def char_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(ch, cnt) of lexicon characters in the corpus."""
    chars = corpus.select(F.make_valid_utf8(F.col(text_col))).mapInArrow(letters_counted, "ch string, n bigint")
    return chars.groupBy("ch").agg(F.sum("n").alias("cnt")).where(T.is_pure(F.col("ch")))


def char_counts_of(chunks: DataFrame) -> DataFrame:
    """char_counts of a corpus from its chunk counts (chunk, n)."""
    chars = chunks.select("chunk", "n").mapInArrow(substrings_counted(1), "ch string, n bigint")
    return chars.groupBy("ch").agg(F.sum("n").alias("cnt")).where(T.is_pure(F.col("ch")))


def filter_by_chars(words: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """Words whose characters all have a count of least or more."""
    chars = words.select("word").where("word <> ''").distinct().select("word", F.explode(F.array_distinct(T.split_chars(F.col("word")))).alias("ch"))
    rare = chars.join(counts.where(F.col("cnt") >= least), "ch", "left_anti").select("word").distinct()
    return words.select("word").where("word <> ''").distinct().join(rare, "word", "left_anti")


def add_single_chars(words: DataFrame, counts: DataFrame) -> DataFrame:
    """words and every basic ideograph of the corpus, however rare."""
    return words.select("word").unionByName(counts.where(F.col("ch").rlike(rf"\A{C.one(C.BASIC)}\z")).select(F.col("ch").alias("word"))).distinct()


def filtered_in_order(words: DataFrame, counts: DataFrame, least: int = 2) -> DataFrame:
    """(word) of filter_by_chars in the order of words (word, line), then the ideographs that come to them, the commonest first."""
    kept = words.where("word <> ''").groupBy("word").agg(F.min("line").alias("line")).join(filter_by_chars(words, counts, least), "word", "left_semi")
    singles = counts.where(F.col("ch").rlike(rf"\A{C.one(C.BASIC)}\z")).select(F.col("ch").alias("word"), "cnt").join(kept, "word", "left_anti")
    rows = kept.select("word", "line", F.lit(0).alias("cnt")).unionByName(singles.select("word", F.lit(None).cast("bigint").alias("line"), "cnt"))
    return rows.orderBy(F.col("line").asc_nulls_last(), F.desc("cnt"), "word").select("word")


def seed_lexicon(runs: DataFrame, least: int, longest: int = 4) -> DataFrame:
    """Substrings of runs (chunk, n) of up to longest characters with a weighted count of least, and all single characters."""
    cut = runs.select("chunk", "n").mapInArrow(substrings_counted(longest), "word string, n bigint")
    return cut.groupBy("word").agg(F.sum("n").alias("freq")).where((F.col("freq") >= least) | (F.char_length("word") == 1))


def word_scores(lexicon: DataFrame) -> DataFrame:
    """(word, lp, unknown): log-probabilities, and that of an unknown word.

    The total counts all rows; of rows with the same word the largest frequency
    counts; frequency 0 scores like 1. Empty words are left out. With a total of 0
    all words score alike.
    """
    checked = lexicon.where("word <> ''").select("word", F.when(F.col("freq") < 0, F.raise_error(F.lit("negative frequency"))).otherwise(F.col("freq")).cast("bigint").alias("freq"))
    total = F.greatest(F.coalesce(F.col("total"), F.lit(0)), F.lit(1)).cast("double")
    sums = checked.agg(F.sum("freq").alias("total"))  # one row
    single = checked.groupBy("word").agg(F.max("freq").alias("freq")).crossJoin(F.broadcast(sums))

    @F.pandas_udf("double")
    def ln(values):
        # the C library's; the JVM's differs in the last bit of some, and that decides between equal paths
        return values.map(math.log)

    return single.select("word", ln(F.greatest("freq", F.lit(1)) / total).alias("lp"), ln(1 / total).alias("unknown"))


def keep_by_loss(losses: DataFrame, lexicon: DataFrame, vocabulary: int, least: int, share: int = 75) -> DataFrame:
    """The words that a round keeps: single characters, and the best of the others by loss / sqrt(count) / length.

    Of the eligible (count of least or more) share percent stay, or as many as fill
    the vocabulary. Ties go to the larger word. losses is read several times, so it
    should be stored; no task sorts or holds more than its share of it.
    """
    single = F.char_length("word") == 1
    singles = lexicon.where(single).select("word").distinct()
    eligible = losses.where(~single & (F.col("cnt") >= least))
    n_singles, n_eligible = singles.count(), eligible.count()
    size = max(vocabulary - n_singles, n_eligible * share // 100)
    score = F.when(F.col("cnt") > 0, F.col("loss") / F.sqrt("cnt") / F.char_length("word")).otherwise(0.0)
    return singles.unionByName(best_k(eligible, size, score, F.col("word")).select("word"))
