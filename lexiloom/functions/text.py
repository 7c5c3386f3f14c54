"""Scalar text functions as Columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charclass as C


def normalize_spaces(text: Column) -> Column:
    """Leading blanks go, each run of U+0020 becomes one mark, and one mark at the end goes."""
    out = F.regexp_replace(text, "^ +", "")
    return F.regexp_replace(F.regexp_replace(out, " +", C.SPACE_MARK), rf"{C.SPACE_MARK}\z", "")


def pretokenize(normal: Column) -> Column:
    """Runs of ideographs, digits and letters, and single other characters."""
    return F.regexp_extract_all(normal, F.lit(C.PRETOKEN), F.lit(1))


def token_kind(token: Column) -> Column:
    first = lambda c: token.rlike(rf"^{c}")
    return F.when(first(C.SPACE_MARK), "space").when(first(C.one(C.HAN)), "han").when(first(C.one(C.DIGIT)), "digit").when(first(C.one(C.LETTER)), "letter").otherwise("punct")


def is_han_run(token: Column) -> Column:
    return token.rlike(rf"^{C.one(C.HAN)}")


def split_chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def split_punct(text: Column) -> Column:
    """Each delimiter alone, and the runs between them."""
    return F.regexp_extract_all(text, F.lit(C.PUNCT_SPLIT), F.lit(1))


def is_punct(segment: Column) -> Column:
    return segment.rlike(rf"^{C.one(C.PUNCT)}")


def split_script(text: Column) -> Column:
    """Runs of ideographs with their symbols, and the runs between them."""
    return F.regexp_extract_all(text, F.lit(C.SCRIPT_SPLIT), F.lit(1))


def is_valid_word(word: Column) -> Column:
    return (word != "") & F.is_valid_utf8(word) & word.rlike(r"[^ \t\n\r]")


def is_pure(word: Column) -> Column:
    """Non-empty and of lexicon characters only."""
    return word.rlike(rf"\A{C.one(C.PURE)}+\z")


def is_good_title(title: Column, least: int = 2) -> Column:
    # Endings of list pages.
    return title.rlike(C.GOOD_TITLE) & (F.char_length(title) >= least) & ~title.endswith("列表") & ~title.endswith("对照表")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, C.STRIP, "")


def strip_headings(text: Column) -> Column:
    """Markdown headings go; blanks behind the hashes may reach over a line end, as in a multi-line match."""
    return F.regexp_replace(text, f"(?md){C.HEADING}", "")


def clean_text(text: Column) -> Column:
    return F.regexp_replace(strip(strip_headings(text)), f"{C.one(C.BLANK)}+", " ")


def sentences(text: Column) -> Column:
    """Sentences with their end marks, stripped, without empty ones."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(C.SENTENCE), F.lit(0)), strip)
    return F.filter(parts, lambda s: s != "")


def to_simplified(text: Column, mapping: dict[str, str]) -> Column:
    """Character conversion with a mapping table of single characters."""
    pairs = sorted((a, b) for a, b in mapping.items() if len(a) == 1 and len(b) == 1)
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else text


def unescape_title(raw: Column) -> Column:
    """A title from a MySQL dump: underscores to blanks, then \\' and \\\\ in that order."""
    out = F.replace(raw, F.lit("_"), F.lit(" "))
    return F.replace(F.replace(out, F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))


def char_count(word: Column, by_bytes: bool = False) -> Column:
    """Characters of a word; by_bytes counts three bytes a character behind a non-ASCII first one."""
    return F.when(F.ascii(word) > 127, F.floor(F.octet_length(word) / 3)).otherwise(F.char_length(word)) if by_bytes else F.char_length(word)


def hanify(text: Column) -> Column:
    """ASCII letters as ideographs, to exercise the segmenter on Latin text."""
    return F.translate(text, LATIN, HANIFIED * 2)


LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# 26 distinct ideographs.
HANIFIED = "的一是不了人我在有他这中大来上国个到说们为子和你地出"
