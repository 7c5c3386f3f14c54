"""Path search over one run of ideographs: the small part that runs per row in Arrow tasks."""

from __future__ import annotations


def best_path(run: str, scores: dict[str, float], unknown: float, longest: int) -> list[str]:
    """The words of the path with the largest sum of scores; of equal paths the one with the shorter word first."""
    n = len(run)
    total, size = [0.0] * n + [1.0], [1] * n
    for at in range(n - 1, -1, -1):
        best = scores.get(run[at], unknown) + total[at + 1]
        for k in range(2, min(longest, n - at) + 1):
            own = scores.get(run[at : at + k])
            if own is not None and own + total[at + k] > best:
                best, size[at] = own + total[at + k], k
        total[at] = best
    out, at = [], 0
    while at < n:
        out.append(run[at : at + size[at]])
        at += size[at]
    return out


def path_losses(run: str, scores: dict[str, float], unknown: float, longest: int) -> list[tuple[str, float]]:
    """For each word of the best path, what the path's score loses without that word.

    Every other path has one edge over the place where the word starts, so the best
    of them is found from the scores of the best ways to and from each edge. The
    loss of a single character is its score over that of an unknown word.
    """
    n = len(run)
    edges: list[list[tuple[int, float]]] = []
    for at in range(n):
        own = [(1, scores.get(run[at], unknown))]
        for k in range(2, min(longest, n - at) + 1):
            value = scores.get(run[at : at + k])
            if value is not None:
                own.append((k, value))
        edges.append(own)
    after, size = [0.0] * n + [1.0], [1] * n
    for at in range(n - 1, -1, -1):
        after[at], size[at] = max(((value + after[at + k], -k) for k, value in edges[at]))
        size[at] = -size[at]
    before = [float("-inf")] * (n + 1)
    before[0] = 0.0
    for at in range(n):
        for k, value in edges[at]:
            before[at + k] = max(before[at + k], before[at] + value)
    out, at = [], 0
    while at < n:
        k = size[at]
        if k == 1:
            loss = edges[at][0][1] - unknown
        else:
            over = (before[a] + value + after[a + m] for a in range(max(0, at - longest + 1), at + 1) for m, value in edges[a] if a + m > at and (a, m) != (at, k))
            loss = after[0] - max(over)
        out.append((run[at : at + k], loss))
        at += k
    return out


def longest_match(segment: str, words: set[str] | dict, longest: int) -> list[str]:
    """From left to right the longest word of the lexicon, else one character."""
    out, at, n = [], 0, len(segment)
    while at < n:
        k = next((k for k in range(min(longest, n - at), 1, -1) if segment[at : at + k] in words), 1)
        out.append(segment[at : at + k])
        at += k
    return out
