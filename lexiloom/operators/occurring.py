"""Which entries of a table of any size stand in texts of any length, and where texts may be cut.

A text is never carried along with each of its places: it is cut into blocks that
reach over their ends by the longest entry, so memory follows the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block, at least.
BLOCK = 128


def longest_of(words: DataFrame, word_col: str = "word") -> int:
    return int(words.agg(F.max(F.char_length(word_col))).first()[0] or 1)


def blocks(rows: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """(key, first, size, text): blocks of every text, with the number of characters before them and of their own; each reaches longest - 1 characters into the next."""
    size = max(BLOCK, longest)
    parts = rows.select(key, F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)).alias("parts"))

    def block(part: Column, i: Column) -> Column:
        after = F.coalesce(F.left(F.get("parts", i + 1), F.lit(longest - 1)), F.lit(""))
        return F.struct((i * size).cast("bigint").alias("first"), F.char_length(part).alias("size"), F.concat(part, after).alias("text"))

    return parts.select(key, F.explode(F.transform("parts", block)).alias("b")).select(key, "b.first", "b.size", "b.text")


def _lengths(at: Column, least: int, longest: int) -> Column:
    """The lengths of entries that may start at a place (from 1) of a block; none where fewer than least characters are left."""
    left = F.char_length("text") - at + 1
    return F.when(left >= least, F.sequence(F.lit(least), F.least(F.lit(longest), left))).otherwise(F.array().cast("array<int>"))


def occurring(rows: DataFrame, key: str, text: str, words: DataFrame, longest: int) -> DataFrame:
    """(key, found): for every text the set of the rows of words (word, ...) whose word stands in it. Texts without any have no row."""
    at = F.sequence(F.lit(1), F.col("size"))
    parts = F.flatten(F.transform(at, lambda p: F.transform(_lengths(p, 1, longest), lambda k: F.substring("text", p, k))))
    own = blocks(rows, key, text, longest).select(key, F.explode(F.array_distinct(parts)).alias("word"))
    return own.join(words, "word").groupBy(key).agg(F.collect_set(F.struct(*words.columns)).alias("found"))


def free_pieces(rows: DataFrame, key: str, text: str, words: DataFrame, longest: int, step: int) -> DataFrame:
    """(key, no, piece): every text in pieces of about step characters, cut only where no word of the table stands over the border.

    Any choice of words along a text can then be made for each piece alone. A
    stretch without such a border stays one piece. Borders are found place by place,
    so a text of any length is worked on by many tasks.
    """
    own = blocks(rows, key, text, longest)
    starts = own.select(key, "first", "text", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("at"))
    spans = starts.select(key, (F.col("first") + F.col("at")).alias("place"), F.explode(_lengths(F.col("at"), 2, longest)).alias("k"), "text", "at")
    found = spans.select(key, "place", "k", F.substring("text", F.col("at"), F.col("k")).alias("word")).join(words.select("word"), "word", "left_semi")
    crossed = found.select(key, F.explode(F.sequence(F.col("place") + 1, F.col("place") + F.col("k") - 1)).alias("place")).distinct()
    free = starts.select(key, (F.col("first") + F.col("at")).alias("place")).where("place > 1").join(crossed, [key, "place"], "left_anti")
    # the first border of each step
    cuts = free.groupBy(key, F.floor(F.col("place") / step).alias("step")).agg(F.min("place").alias("place"))
    cuts = cuts.where("step > 0").groupBy(key).agg(F.array_sort(F.collect_list("place")).alias("cuts"))
    borders = F.concat(F.array(F.lit(1).cast("bigint")), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(F.char_length(text).cast("bigint") + 1))
    whole = rows.select(key, text).join(cuts, key, "left").select(key, text, borders.alias("borders"))
    ranges = F.transform(F.sequence(F.lit(1), F.size("borders") - 1), lambda i: F.struct(F.get("borders", i - 1).alias("from"), F.get("borders", i).alias("to")))
    each = whole.select(key, text, F.posexplode(ranges).alias("no", "range"))
    return each.select(key, "no", F.substring(text, F.col("range.from").cast("int"), (F.col("range.to") - F.col("range.from")).cast("int")).alias("piece"))
