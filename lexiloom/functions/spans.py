"""Texts in spans of characters of one class, many texts at once in Arrow tasks.

The splits are those of text.pretokenize and text.split_punct; a span is a piece of
the batch's own bytes, so nothing is copied and no span becomes a Python string.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import charclass as C

#: Bytes of text that are worked on at once.
PART = 1 << 19
OTHER, LETTER, SPACE, APOSTROPHE = 0, 3, 4, 0x27


def table_of(*classes) -> np.ndarray:
    """For every code point the number, from 1, of the class that has it; 0 for the others."""
    table = np.zeros(0x110000, np.uint8)
    for number, ranges in enumerate(classes, 1):
        for first, last in ranges:
            table[first : last + 1] = number
    return table


@cache
def _pretoken_table() -> np.ndarray:
    return table_of(C.HAN, C.DIGIT, C.LETTER, ((0x20, 0x20),))


@cache
def _punct_table() -> np.ndarray:
    return 1 - table_of(C.PUNCT)


@cache
def _blank_table() -> np.ndarray:
    return 2 - table_of(((0x0A, 0x0A), (0x20, 0x20)))


def parts(batch: pa.RecordBatch, at: int = 0, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """batch in slices of about size (or else PART) bytes in its text column, of one row at least."""
    size = PART if size is None else size
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, end - start)
        start = end


class Letters:
    """The code points of texts, the place of each in their bytes and the first one of each text; null texts are empty."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.data = data.slice(int(ends[0]), int(ends[-1] - ends[0])) if data is not None else pa.py_buffer(b"")
        self.places = np.flatnonzero((np.frombuffer(self.data, np.uint8) & 0xC0) != 0x80)
        self.points = np.frombuffer(str(self.data, "utf-8").encode("utf-32-le"), np.uint32)
        self.first = np.searchsorted(self.places, ends - ends[0])

    def pieces(self, kinds: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
        """The letters where pieces start, the pieces, and the number of pieces before each text: letters of one kind in a row, or one of kind OTHER."""
        new = np.ones(len(kinds), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == OTHER)
        new[self.first[self.first < len(kinds)]] = True
        begin = np.flatnonzero(new)
        offsets = np.append(self.places[begin], self.data.size).astype(np.int32)
        return begin, pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), self.data), np.searchsorted(begin, self.first)


def pretokens(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """(pieces, number of pieces before each text and of all): pretokenize(normalize_spaces()) of all texts, where named() has yet to turn runs of blanks into marks."""
    letters = Letters(texts)
    kinds, points, first = _pretoken_table()[letters.points], letters.points, letters.first
    starts = np.zeros(len(kinds) + 1, bool)
    starts[first] = True
    at = np.flatnonzero(points[1:-1] == APOSTROPHE) + 1
    inner = at[(kinds[at - 1] == LETTER) & (kinds[at + 1] == LETTER) & ~starts[at] & ~starts[at + 1]]
    kinds[inner] = LETTER
    begin, pieces, before = letters.pieces(kinds)
    kept = np.ones(len(begin), bool)
    lead = before[:-1][before[:-1] < before[1:]]
    kept[lead[kinds[begin[lead]] == SPACE]] = False
    last = before[1:][before[:-1] < before[1:]] - 1
    kept[last[(kinds[begin[last]] == SPACE) | (points[begin[last]] == ord(C.SPACE_MARK))]] = False
    return pieces.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[before]


def segments(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The same for split_punct() of all texts."""
    letters = Letters(texts)
    return letters.pieces(_punct_table()[letters.points])[1:]


def rewritten(texts: pa.Array, kinds: np.ndarray, rewrite) -> pa.Array:
    """texts with their pieces of kind 1 rewritten, of which rewrite gets each distinct one once, as a list; null stays null. kinds has no OTHER."""
    letters = Letters(texts)
    _, pieces, before = letters.pieces(kinds[letters.points])
    pieces = pieces.dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    own = [i for i, piece in enumerate(distinct) if kinds[ord(piece[0])] == 1]
    for i, new in zip(own, rewrite([distinct[i] for i in own]), strict=True):
        distinct[i] = new
    # what belongs to a text stands together again
    whole = pa.array(distinct, pa.string()).take(pieces.indices)
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1) if len(whole) else np.zeros(1, np.int32)
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets[before]), whole.buffers()[2] or pa.py_buffer(b""))
    return pc.if_else(texts.is_valid(), out, None)


def named(pieces: pa.StringArray) -> pa.StringArray:
    """Pieces as they are called: a run of blanks is one mark."""
    return pc.if_else(pc.starts_with(pieces, " "), C.SPACE_MARK, pieces)


def counted(split):
    """(piece, n) of the texts of batches; a piece may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                counts = split(part.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["chunk", "n"])

    return run


def words_between_blanks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) of the texts of batches: what stands between blanks and line ends; a word may come several times."""
    for batch in batches:
        for part in parts(batch):
            letters = Letters(part.column(0))
            kinds = _blank_table()[letters.points]
            begin, pieces, _ = letters.pieces(kinds)
            yield pa.RecordBatch.from_arrays([pieces.filter(pa.array(kinds[begin] == 2)).unique()], names=["word"])


def letters_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ch, n) of the texts of batches; a letter may come several times."""
    for batch in batches:
        for part in parts(batch):
            points, counts = np.unique(Letters(part.column(0)).points, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(map(chr, points.tolist()), pa.string()), pa.array(counts)], names=["ch", "n"])


def substrings_counted(longest: int):
    """(word, n) of the substrings of up to longest letters of texts (text, n), each n times; a word may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                letters = Letters(part.column(0))
                text = letters.points.tobytes().decode("utf-32-le")
                sizes = np.diff(letters.first)
                left = np.repeat(letters.first[1:], sizes) - np.arange(len(letters.points))
                weight = np.repeat(part.column(1).to_numpy(), sizes)
                kinds, letter = np.unique(letters.points, return_inverse=True)
                at, code = np.arange(len(letter)), np.zeros(len(letter), np.int64)
                for size in range(1, longest + 1):
                    inside = left[at] >= size
                    at, code = at[inside], code[inside]
                    if not at.size:
                        break
                    # words of one size are told apart by number, so the numbers stay small
                    _, first, code = np.unique(code * len(kinds) + letter[at + size - 1], return_index=True, return_inverse=True)
                    sums = np.zeros(len(first), np.int64)
                    np.add.at(sums, code, weight[at])
                    words = [text[i : i + size] for i in at[first].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sums)], names=["word", "n"])

    return run


def translated(table: dict[str, str], names: list[str]):
    """The last column of batches, texts, with letters replaced by table; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = np.arange(0x110000, dtype=np.uint32)
        target[[ord(c) for c in table]] = [ord(c) for c in table.values()]
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                letters = Letters(part.column(part.num_columns - 1))
                points = target[letters.points]
                ends = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])
                texts = pa.StringArray.from_buffers(part.num_rows, pa.py_buffer(ends[letters.first].astype(np.int32)), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
                texts = pc.if_else(part.column(part.num_columns - 1).is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=names)

    return run
