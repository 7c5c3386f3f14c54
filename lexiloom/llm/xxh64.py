"""XXH64 of many byte spans at once, after its published specification."""

from __future__ import annotations

import numpy as np

# Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unsigned XXH64 of buf[start:end] for each pair of offsets."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    half = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    seed = np.uint64(seed)
    length = (end - start).astype(np.int64)
    at = start.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        acc = np.full(len(start), seed + P5, np.uint64)
        long = np.flatnonzero(length >= 32)
        if len(long):
            lanes = [np.full(len(long), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            stripes, p, on = length[long] // 32, at[long], np.arange(len(long))
            k = 0
            while len(on):
                for i in range(4):
                    lanes[i][on] = _round(lanes[i][on], words[p[on] + 8 * i])
                p[on] += 32
                k += 1
                on = on[stripes[on] > k]
            merged = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                merged = (merged ^ _round(np.uint64(0), lane)) * P1 + P4
            acc[long], at[long] = merged, p
        acc += length.astype(np.uint64)
        stop = end.astype(np.int64)
        on = np.flatnonzero(stop - at >= 8)
        while len(on):
            p = at[on]
            acc[on] = _rotl(acc[on] ^ _round(np.uint64(0), words[p]), 27) * P1 + P4
            at[on] = p + 8
            on = on[stop[on] - p >= 16]
        on = np.flatnonzero(stop - at >= 4)
        if len(on):
            p = at[on]
            acc[on] = _rotl(acc[on] ^ (half[p].astype(np.uint64) * P1), 23) * P2 + P3
            at[on] = p + 4
        on = np.flatnonzero(stop > at)
        while len(on):
            p = at[on]
            acc[on] = _rotl(acc[on] ^ (raw[p].astype(np.uint64) * P5), 11) * P1
            at[on] = p + 1
            on = on[stop[on] > p + 1]
        acc ^= acc >> np.uint64(33)
        acc *= P2
        acc ^= acc >> np.uint64(29)
        acc *= P3
        acc ^= acc >> np.uint64(32)
    return acc
