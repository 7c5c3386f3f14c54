"""MySQL dumps and wikitext."""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from datetime import datetime
from email.utils import parsedate_to_datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.convert import converted
from .splits import split_tuples

#: What bytes that aren't UTF-8 are read as; no title has it otherwise.
REPLACED = "\ufffd"
_FIELD = r"'(?:\\.|[^'\\])*+'|[^,()']++"
_TUPLE = rf"\(((?:{_FIELD})?(?:,(?:{_FIELD})?)*)\)"


def insert_tuples(lines: DataFrame, line_col: str = "value", size: int | None = None) -> DataFrame:
    """The fields of every tuple of INSERT lines; quoted fields lose their quotes and keep their escapes.

    size: lines are long and are read in pieces of so many characters, in parallel.
    """
    if size:
        return _fields_of(split_tuples(lines, line_col, size))
    line = F.col(line_col)
    data = F.when(line.startswith("INSERT") & line.contains("VALUES "), F.expr(f"substr({line_col}, instr({line_col}, 'VALUES ') + 7)"))
    each = lines.select(F.explode(F.regexp_extract_all(data, F.lit(_TUPLE), F.lit(1))).alias("tuple"))
    return _fields_of(each)


def _fields_of(tuples: DataFrame) -> DataFrame:
    fields = F.regexp_extract_all("tuple", F.lit(rf"({_FIELD})"), F.lit(1))
    bare = lambda f: F.when(f.startswith("'"), F.substring(f, F.lit(2), F.char_length(f) - 2)).otherwise(f)
    return tuples.select(F.transform(fields, bare).alias("fields"))


def redirects(tuples: DataFrame) -> DataFrame:
    """(rd_from, rd_title) of namespace 0, without titles that aren't UTF-8."""
    rows = tuples.where(F.size("fields") >= 3).select(F.get("fields", F.lit(0)).cast("bigint").alias("rd_from"), F.get("fields", F.lit(1)).cast("int").alias("ns"), T.unescape_title(F.get("fields", F.lit(2))).alias("rd_title"))
    return rows.where((F.col("ns") == 0) & ~F.contains("rd_title", F.lit(REPLACED))).select("rd_from", "rd_title")


def pages(tuples: DataFrame) -> DataFrame:
    """(page_id, page_title) of namespace 0, without titles that aren't UTF-8."""
    rows = tuples.where(F.size("fields") >= 5).select(F.get("fields", F.lit(0)).cast("bigint").alias("page_id"), F.get("fields", F.lit(1)).cast("int").alias("ns"), T.unescape_title(F.get("fields", F.lit(2))).alias("page_title"))
    return rows.where((F.col("ns") == 0) & ~F.contains("page_title", F.lit(REPLACED))).select("page_id", "page_title")


def redirect_pairs(page_rows: DataFrame, redirect_rows: DataFrame, mapping=None, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """(source, target) titles of redirect pages, converted by mapping and tables, in the order of the titles before that. Of repeated rd_from the largest title counts."""
    single = redirect_rows.groupBy("rd_from").agg(F.max("rd_title").alias("rd_title"))
    joined = page_rows.join(single, page_rows["page_id"] == single["rd_from"])
    pairs = joined.select("page_title", "rd_title", F.col("page_title").alias("source"), F.col("rd_title").alias("target"))
    return converted(converted(pairs, "source", mapping, tables), "target", mapping, tables).orderBy("page_title", "rd_title").select("source", "target")


_BRACES = re.compile(r"\{\{|\}\}")


def _outside(marks: list[str]) -> list[bool]:
    """For the parts before, between and behind marks whether they stand outside of all templates; raises where the marks don't match."""
    out, depth = [True], 0
    for mark in marks:
        depth += 1 if mark == "{{" else -1
        if depth < 0:
            break
        out.append(not depth)
    if depth:
        raise ValueError("unbalanced template in wikitext")
    return out


def without_templates(source: str) -> str:
    """source without {{...}}, however deep they nest, in one pass over its braces; raises where they don't match."""
    return "".join(part for part, kept in zip(_BRACES.split(source), _outside(_BRACES.findall(source)), strict=True) if kept)


def trim_templates(wikitext: Column) -> Column:
    """Text without {{...}}; raises where braces don't match. Null stays null. Only the braces go to Python, the text doesn't."""

    @F.pandas_udf("array<boolean>")
    def outside(marks):
        return marks.map(lambda m: _outside([m[i : i + 2] for i in range(0, len(m), 2)]), na_action="ignore")

    marks = F.array_join(F.regexp_extract_all(wikitext, F.lit(f"({_BRACES.pattern})"), F.lit(1)), "")
    parts = F.zip_with(F.split(wikitext, _BRACES.pattern, -1), outside(marks), lambda part, kept: F.when(kept, part))
    return F.when(wikitext.contains("{{") | wikitext.contains("}}"), F.array_join(parts, "")).otherwise(wikitext)


def bolds(line: Column) -> Column:
    """What stands between pairs of three quotes; raises on an unclosed one."""
    marks = F.size(F.split(line, "'''")) - 1
    return F.when(marks % 2 == 1, F.raise_error(F.lit("unclosed bold in wikitext"))).otherwise(F.regexp_extract_all(line, F.lit("(?s)'''(.*?)'''"), F.lit(1)))


# What separates words in a list line, and what is removed from words, in this order.
SEPARATORS = "[、/|，。?？(（]"
GARBAGE = ("[", "]", "…", ":", "：", ")", "）", '"', "“", "”", "-{", "}-", "简称", "簡稱")


def list_words(wiki_pages: DataFrame, source_col: str = "source") -> DataFrame:
    """Distinct words in bold from the list lines of wikitext pages.

    Bold words before the first bold colon are taken, those behind it only if they
    have over two characters. In a line without one all are taken.
    """
    lines = wiki_pages.select(F.explode(F.split(trim_templates(F.col(source_col)), "\n")).alias("line")).where(F.col("line").startswith("*"))
    line = T.strip(F.regexp_replace("line", r"\A\*+|\*+\z", ""))
    lines = lines.select(line.alias("line"))
    at = lambda mark: F.instr("line", mark)
    cut = F.when(at("'''：") > 0, at("'''：")).when(at("''':") > 0, at("''':")).otherwise(F.char_length("line"))
    lines = lines.withColumn("cut", cut)
    before, after = F.expr("substr(line, 1, cut + 3)"), F.expr("substr(line, cut + 4)")
    taken = F.concat(bolds(before), F.filter(bolds(after), lambda b: F.char_length(b) > 2))
    words = lines.select(F.explode(taken).alias("bold")).distinct().select(F.explode(F.split("bold", SEPARATORS)).alias("word")).distinct()
    word = T.strip(F.col("word"))
    for g in GARBAGE:
        word = F.replace(word, F.lit(g), F.lit(""))
    return words.select(T.strip(word).alias("word")).distinct()


def send_with_retries(send, attempts: int = 10, sleep=time.sleep):
    """The body of send(), which returns (status, headers, body); status 429 waits as its Retry-After tells and tries again, any other but 200 raises."""
    for _ in range(attempts):
        status, headers, body = send()
        if status == 200:
            return body
        if status != 429:
            raise OSError(f"status {status}")
        sleep(retry_delay(headers.get("Retry-After")))
    raise OSError(f"still refused after {attempts} attempts")


def retry_delay(header: str | None, now: datetime | None = None) -> int:
    """Seconds to wait by a Retry-After header: a number, an HTTP date, or 0 for neither."""
    if not header:
        return 0
    try:
        return int(header)
    except ValueError:
        pass
    try:
        until = parsedate_to_datetime(header)
    except (TypeError, ValueError):
        return 0
    return max(0, int((until - (now or datetime.now(until.tzinfo))).total_seconds()))
