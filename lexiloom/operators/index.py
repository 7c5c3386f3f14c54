"""A sorted index of words that the Python workers of an executor share.

Spark sorts the lexicon and writes it to the checkpoint folder; executors fetch its
parts once, as files of the session, and the first worker that needs them lays the
words out as arrays in the executor's own folder, which all workers map into memory.
An executor that is lost takes its copy with it, its successor fetches and lays out
anew. The driver has the files on its disk, as addFile does it, and no words in memory
but where it cuts single sentences itself, with the same mapped arrays.
"""

from __future__ import annotations

import base64
import fcntl
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from ..storage import shared_folder

#: Up to this many words are indexed: about 40 bytes a word on each executor's disk and in its page cache.
INDEX_WORDS = 20_000_000
#: Words in a part of the index.
PART_WORDS = 500_000
#: Places that are looked up at once.
PLACES = 1 << 18
#: Stands between runs; no word has it.
BORDER = (1 << 21) - 1


def write_index(words: DataFrame, count: int) -> IndexFiles:
    """The index of words (word, lp), which are distinct, not empty and count many."""
    folder = f"{shared_folder(words.sparkSession)}/index-{uuid.uuid4().hex}"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            letters = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4")
            sizes = np.fromiter(map(len, rows), "<u4", len(rows))
            block = np.uint32(len(rows)).tobytes() + sizes.tobytes() + batch.column(1).to_numpy().tobytes() + letters.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([base64.b64encode(block).decode()])], names=["value"])

    # the order of UTF-8 bytes is that of code points
    dealt = words.select("word", "lp").repartitionByRange(max(1, -(-count // PART_WORDS)), "word").sortWithinPartitions("word")
    dealt.mapInArrow(packed, "value string").write.text(folder, compression="none")
    spark = words.sparkSession
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    parts = sorted(str(status.getPath()) for status in pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern))
    for part in parts:
        spark.sparkContext.addFile(part)
    return IndexFiles(folder.rsplit("/", 1)[1], [part.rsplit("/", 1)[1] for part in parts])


class IndexFiles:
    """The names of an index's files; open() gives the index in any worker."""

    _opened: dict[str, PrefixIndex] = {}

    def __init__(self, name: str, parts: list[str]):
        self.name, self.parts = name, parts

    def open(self) -> PrefixIndex:
        if self.name not in self._opened:
            root = SparkFiles.getRootDirectory()
            folder = os.path.join(root, self.name)
            with open(f"{folder}.lock", "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                if not os.path.exists(folder):
                    lay_out([SparkFiles.get(part) for part in self.parts], folder)
            self._opened[self.name] = PrefixIndex(folder)
        return self._opened[self.name]


def lay_out(parts: list[str], folder: str) -> None:
    """The words of parts, in order, as arrays in folder, which is there as a whole or not at all."""
    making = f"{folder}.{uuid.uuid4().hex}"
    os.mkdir(making)
    end, longest, count = 0, 0, 0
    with open(f"{making}/letters", "wb") as letters, open(f"{making}/starts", "wb") as starts, open(f"{making}/scores", "wb") as scores:
        starts.write(np.int64(0).tobytes())
        for part in parts:
            with open(part, "rb") as lines:
                for line in lines:
                    block = base64.b64decode(line)
                    n = int(np.frombuffer(block, "<u4", 1)[0])
                    sizes = np.frombuffer(block, "<u4", n, 4).astype(np.int64)
                    scores.write(block[4 + 4 * n : 4 + 12 * n])
                    letters.write(block[4 + 12 * n :])
                    ends = end + np.cumsum(sizes)
                    starts.write(ends.tobytes())
                    end, longest, count = int(ends[-1]), max(longest, int(sizes.max())), count + n
    with open(f"{making}/sizes.json", "w") as out:
        json.dump({"longest": longest, "count": count}, out)
    os.rename(making, folder)


class PrefixIndex:
    """Words in order as one array of letters, with their starts and scores, mapped from files."""

    def __init__(self, folder: str):
        with open(f"{folder}/sizes.json") as sizes:
            told = json.load(sizes)
        self.longest, self.count = told["longest"], told["count"]
        read = lambda name, kind: np.memmap(f"{folder}/{name}", kind, "r") if self.count else np.zeros(0, kind)
        self.letters, self.starts, self.scores = read("letters", "<u4"), read("starts", "<i8"), read("scores", "<f8")

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, letter: np.ndarray) -> np.ndarray:
        """Of each range of words that share depth letters the first one whose next letter is at least letter."""
        low, high = low.copy(), high.copy()
        rest = np.flatnonzero(low < high)
        while rest.size:
            middle = (low[rest] + high[rest]) >> 1
            at = self.starts[middle] + depth
            ended = at >= self.starts[middle + 1]
            before = ended | (self.letters[np.where(ended, 0, at)] < letter[rest])
            low[rest[before]] = middle[before] + 1
            high[rest[~before]] = middle[~before]
            rest = rest[low[rest] < high[rest]]
        return low

    def found(self, letters: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, row) of all words that start in letters at first to last - 1, in order of place and size."""
        at = np.arange(first, last)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.count, np.int64)
        out = []
        for depth in range(self.longest):
            inside = at + depth < len(letters)
            at, low, high = at[inside], low[inside], high[inside]
            if not at.size:
                break
            # equal beginnings are looked up once
            asked, back = np.unique(low << 21 | letters[at + depth], return_inverse=True)
            once = np.zeros(len(asked), np.int64)
            once[back] = high
            start, letter = asked >> 21, asked & BORDER
            begin = self._bound(start, once, depth, letter)
            end = self._bound(begin, once, depth, letter + 1)
            low, high = begin[back], end[back]
            kept = low < high
            at, low, high = at[kept], low[kept], high[kept]
            # a word stands before all that it begins
            whole = self.starts[low + 1] - self.starts[low] == depth + 1
            out.append((at[whole], np.full(int(whole.sum()), depth + 1), low[whole]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, size, row = map(np.concatenate, zip(*out, strict=True))
        order = np.lexsort((size, place))
        return place[order], size[order], row[order]


def _groups(runs: list[str]) -> Iterator[list[str]]:
    """runs in order, as many at once as have PLACES letters, at least one."""
    group, size = [], 0
    for run in runs:
        if group and size + len(run) > PLACES:
            yield group
            group, size = [], 0
        group.append(run)
        size += len(run) + 1
    if group:
        yield group


def _letters(group: list[str]) -> np.ndarray:
    """The letters of all runs, each with a BORDER behind it."""
    parts = (x for run in group for x in (np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4"), np.array([BORDER], "<u4")))
    return np.concatenate(list(parts)).astype(np.int64)


def _tokens(group: list[str], sizes: list[int]) -> Iterator[list[str]]:
    """The words of each run, where sizes tells at every place of the group how long the word is that starts there."""
    base = 0
    for run in group:
        at, tokens = 0, []
        while at < len(run):
            size = sizes[base + at]
            tokens.append(run[at : at + size])
            at += size
        base += len(run) + 1
        yield tokens


def best_paths(runs: list[str], index: PrefixIndex, unknown: float) -> list[list[str]]:
    """kernels.best_path of every run."""
    out: list[list[str]] = []
    for group in _groups(runs):
        letters = _letters(group)
        n = len(letters)
        total, size = [0.0] * n + [1.0], [1] * n
        for first in range((n - 1) // PLACES * PLACES, -1, -PLACES):
            last = min(first + PLACES, n)
            place, words, row = index.found(letters, first, last)
            edge, k, lp = np.searchsorted(place, np.arange(first, last + 1)).tolist(), words.tolist(), index.scores[row].tolist()
            border = (letters[first:last] == BORDER).tolist()
            for i in range(last - first - 1, -1, -1):
                at = first + i
                if border[i]:
                    total[at] = 1.0
                    continue
                e, stop = edge[i], edge[i + 1]
                if e < stop and k[e] == 1:
                    best = lp[e] + total[at + 1]
                    e += 1
                else:
                    best = unknown + total[at + 1]
                while e < stop:
                    score = lp[e] + total[at + k[e]]
                    if score > best:
                        best, size[at] = score, k[e]
                    e += 1
                total[at] = best
        out += _tokens(group, size)
    return out


def longest_matches(segments: list[str], index: PrefixIndex, _: float = 0.0) -> list[list[str]]:
    """kernels.longest_match of every segment."""
    out: list[list[str]] = []
    for group in _groups(segments):
        letters = _letters(group)
        size = np.ones(len(letters), np.int64)
        for first in range(0, len(letters), PLACES):
            place, words, _rows = index.found(letters, first, min(first + PLACES, len(letters)))
            # of several words at a place the last one is the longest
            last = np.append(place[1:] != place[:-1], True)[: len(place)]
            size[place[last]] = words[last]
        out += _tokens(group, size.tolist())
    return out
