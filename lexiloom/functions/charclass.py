"""Character classes as code-point ranges; one source for Spark's and DuckDB's regular expressions.

There are several notions of "Chinese character"; operators must not mix them.
"""

from __future__ import annotations

# Ranges that tokens and filters are defined by.
SPACE_MARK = "▁"
#: Runs that the segmenter cuts.
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))
DIGIT = ((0x30, 0x39), (0xFF10, 0xFF19))
LETTER = (
    (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x85F), (0x900, 0x1FFF), (0x2E80, 0x2FFF), (0x3040, 0x33FF), (0x4DC0, 0x4DFF),
    (0xA000, 0xABFF), (0xAC00, 0xD7FF), (0xFB00, 0xFDFF), (0xFE70, 0xFEFF), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFF9F), (0xFFA0, 0xFFDC), (0x10000, 0x10FFF),
)
#: Delimiters of the longest-match segmenter.
PUNCT = ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Extension blocks, listed one by one.
EXTENSIONS = ((0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x30000, 0x3134F))
#: Ideographs with their symbols, for splitting by script.
SCRIPT = ((0x3000, 0x303F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF01, 0xFF60), *EXTENSIONS)
#: Characters that words of a lexicon may consist of, and that are counted in a corpus.
PURE = ((0x3007, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), *EXTENSIONS, (0x31350, 0x323AF))
#: Single characters that a corpus adds to a lexicon.
BASIC = ((0x4E00, 0x9FFF),)
#: Unified ideographs (with the twelve among the compatibility block), and what else a title may hold.
TITLE = (
    (0x2D, 0x2D), (0xB7, 0xB7), (0x2010, 0x2010), (0x2013, 0x2014), (0x3006, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xFA0E, 0xFA0F), (0xFA11, 0xFA11),
    (0xFA13, 0xFA14), (0xFA1F, 0xFA1F), (0xFA21, 0xFA21), (0xFA23, 0xFA24), (0xFA27, 0xFA29), *EXTENSIONS, (0x31350, 0x323AF),
)
VARIATION = ((0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
#: White space as Python's re has it.
BLANK = ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def inner(*classes) -> str:
    """The inside of a bracket expression for the given ranges."""
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for c in classes for a, b in c)


def one(*classes) -> str:
    return f"[{inner(*classes)}]"


def none_of(*classes) -> str:
    return f"[^{inner(*classes)}]"


def python_class(*classes, inside: bool = True) -> str:
    """A bracket expression for Python's re; inside False negates it."""
    return f"[{'' if inside else '^'}" + "".join(f"\\U{a:08x}-\\U{b:08x}" for c in classes for a, b in c) + "]"


#: Han runs, digit runs, letter runs with inner apostrophes, and single other characters.
PRETOKEN = rf"(?s)({one(HAN)}+|{one(DIGIT)}+|{one(LETTER)}+(?:'{one(LETTER)}+)*|.)"
PUNCT_SPLIT = rf"(?s)({one(PUNCT)}|{none_of(PUNCT)}+)"
SCRIPT_SPLIT = rf"(?s)({one(SCRIPT)}+|{none_of(SCRIPT)}+)"
HEADING = rf"^#+{one(BLANK)}+[^\n]*$"
STRIP = rf"\A{one(BLANK)}+|{one(BLANK)}+\z"
SENTENCE = "[^。！？]*[。！？]|[^。！？]+"
GOOD_TITLE = rf"\A(?:{one(TITLE)}{one(VARIATION)}?)+\z"
