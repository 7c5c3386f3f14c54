"""Path search, losses and longest match of many runs at once, as kernels.py has them run by run: all runs take a step together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..functions.spans import Letters, parts


class Trie:
    """Scored words, level by level: of each beginning of words its number, and its score if it is a word."""

    def __init__(self, scores: dict[str, float], unknown: float = 0.0):
        words = [w for w in scores if w]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        values = np.fromiter((scores[w] for w in words), np.float64, len(words))
        first = np.cumsum(sizes) - sizes
        self.unknown, self.longest = unknown, int(sizes.max(initial=1))
        self.alphabet = np.unique(points)
        letter = np.searchsorted(self.alphabet, points)
        self.levels, state, at = [], np.zeros(len(words), np.int64), np.arange(len(words))
        for depth in range(self.longest if words else 0):
            inside = sizes[at] > depth
            at, state = at[inside], state[inside]
            keys, state = np.unique(state * (len(self.alphabet) + 1) + letter[first[at] + depth], return_inverse=True)
            own, ended = np.full(len(keys), -np.inf), sizes[at] == depth + 1
            own[state[ended]] = values[at[ended]]
            self.levels.append((keys, own))

    def edges(self, points: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """For each size from 1 the score of the word of that size at every letter, or -inf; left tells how many letters its run has from there."""
        n = len(points)
        letter = np.searchsorted(self.alphabet, points)
        letter[(letter == len(self.alphabet)) | (self.alphabet[letter.clip(max=max(len(self.alphabet) - 1, 0))] != points if len(self.alphabet) else True)] = len(self.alphabet)
        out, at, state = [], np.arange(n), np.zeros(n, np.int64)
        for depth, (keys, scores) in enumerate(self.levels):
            inside = left[at] > depth
            at, state = at[inside], state[inside]
            code = state * (len(self.alphabet) + 1) + letter[at + depth]
            state = np.searchsorted(keys, code).clip(max=len(keys) - 1)
            hit = keys[state] == code
            at, state = at[hit], state[hit]
            own = np.full(n, -np.inf)
            own[at] = scores[state]
            out.append(own)
        return out or [np.full(n, -np.inf)]


class Runs:
    """Texts by their letters; slots are places between letters, one more than letters in each run."""

    def __init__(self, texts: pa.Array, trie: Trie):
        self.letters = letters = Letters(texts)
        self.n, self.start, self.end = len(letters.points), letters.first[:-1], letters.first[1:]
        self.sizes = self.end - self.start
        self.run = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.edges = trie.edges(letters.points, np.repeat(self.end, self.sizes) - np.arange(self.n))
        # the longest first, so the runs that still have letters are the first ones
        self.order = np.argsort(-self.sizes, kind="stable")
        self.ordered = self.sizes[self.order]

    def _having(self, size: int) -> np.ndarray:
        return self.order[: int(np.searchsorted(-self.ordered, -size, side="right"))]

    def longest(self) -> np.ndarray:
        size = np.ones(self.n, np.int64)
        for k, own in enumerate(self.edges[1:], 2):
            size[own > -np.inf] = k
        return size

    def best(self, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """(size of the best path's word at every letter, score from every slot to the end)."""
        self.edges[0] = np.where(self.edges[0] == -np.inf, unknown, self.edges[0])
        total, size = np.ones(self.n + len(self.sizes)), np.ones(self.n, np.int64)
        for step in range(1, int(self.sizes.max(initial=0)) + 1):
            runs = self._having(step)
            at = self.end[runs] - step
            slot = at + runs
            best, own = self.edges[0][at] + total[slot + 1], np.ones(len(at), np.int64)
            for k in range(2, min(len(self.edges), step) + 1):
                score = self.edges[k - 1][at] + total[slot + k]
                better = score > best
                best[better], own[better] = score[better], k
            total[slot], size[at] = best, own
        return size, total

    def starts(self, size: np.ndarray) -> np.ndarray:
        """The letters where words start, in order."""
        begin, at = np.zeros(self.n, bool), self.start[self.sizes > 0]
        end = self.end[self.sizes > 0]
        while len(at):
            begin[at] = True
            at = at + size[at]
            more = at < end
            at, end = at[more], end[more]
        return np.flatnonzero(begin)

    def words(self, starts: np.ndarray) -> pa.StringArray:
        offsets = np.append(self.letters.places[starts], self.letters.data.size).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), self.letters.data)

    def losses(self, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """(starts, loss of each word of the best paths)."""
        size, after = self.best(unknown)
        before = np.full(self.n + len(self.sizes), -np.inf)
        before[self.start + np.arange(len(self.sizes))] = 0.0
        for step in range(int(self.sizes.max(initial=0))):
            runs = self._having(step + 1)
            at = self.start[runs] + step
            slot = at + runs
            for k in range(1, len(self.edges) + 1):
                inside = self.sizes[runs] - step >= k
                to, own = slot[inside] + k, before[slot[inside]] + self.edges[k - 1][at[inside]]
                before[to] = np.maximum(before[to], own)
        starts = self.starts(size)
        run, own = self.run[starts], size[starts]
        loss = self.edges[0][starts] - unknown
        other = np.full(len(starts), -np.inf)
        for back in range(len(self.edges)):
            for k in range(back + 1, len(self.edges) + 1):
                at = starts - back
                good = (at >= self.start[run]) & (at + k <= self.end[run]) & ~((own == k) & (back == 0))
                a, r = at[good], run[good]
                other[good] = np.maximum(other[good], before[a + r] + self.edges[k - 1][a] + after[a + r + k])
        whole = after[self.start[run] + run]
        return starts, np.where(own == 1, loss, whole - other)


def _parts(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[tuple[pa.RecordBatch, Runs]]:
    for batch in batches:
        for part in parts(batch):
            yield part, Runs(part.column(0), trie)


def _sums(words: pa.StringArray, weights: list[np.ndarray]) -> tuple[pa.Array, list[np.ndarray]]:
    words = words.dictionary_encode()
    at, out = words.indices.to_numpy(), []
    for w in weights:
        sums = np.zeros(len(words.dictionary), w.dtype)
        np.add.at(sums, at, w)
        out.append(sums)
    return words.dictionary, out


def cut_column(shared, match: bool = False):
    """(run, tokens) of batches of runs, by best path or longest match."""

    def run(batches):
        trie = shared.value
        for part, runs in _parts(batches, trie):
            starts = runs.starts(runs.longest() if match else runs.best(trie.unknown)[0])
            offsets = np.searchsorted(starts, runs.letters.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), runs.words(starts))], names=["chunk", "tokens"])

    return run


def counted_tokens(shared, match: bool = False):
    """(word, n) of batches (run, n): the words of all runs, each as often as its run; a word may come several times."""

    def run(batches):
        trie = shared.value
        for part, runs in _parts(batches, trie):
            starts = runs.starts(runs.longest() if match else runs.best(trie.unknown)[0])
            words, (n,) = _sums(runs.words(starts), [part.column(1).to_numpy()[runs.run[starts]]])
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return run


def summed_losses(shared):
    """(word, loss, cnt) of batches (run, n), summed over the runs of a part; a word may come several times."""

    def run(batches):
        trie = shared.value
        for part, runs in _parts(batches, trie):
            starts, loss = runs.losses(trie.unknown)
            n = part.column(1).to_numpy()[runs.run[starts]]
            words, (lost, cnt) = _sums(runs.words(starts), [n * loss, n])
            yield pa.RecordBatch.from_arrays([words, pa.array(lost), pa.array(cnt)], names=["word", "loss", "cnt"])

    return run
