"""Vectorised byte kernels that run inside Arrow tasks.

Texts arrive as one byte buffer with document offsets. Every kernel works on
bounded slices of it, so a worker's memory follows SLICE_BYTES and the longest
single document, not the size of an Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_DOCUMENTS = 2 << 20, 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges [i, j) of documents of about limit bytes and at most SLICE_DOCUMENTS; a longer document comes alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1), i + SLICE_DOCUMENTS)
        yield i, j
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, broken at document boundaries."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    at = off[:-1][off[1:] > off[:-1]]
    first[at] = mask[at]
    at = off[1:][off[1:] > off[:-1]] - 1
    last[at] = mask[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(buf: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any substring."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(MULTIPLIER, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal bytes at any place."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


_zstd = pa.Codec("zstd", compression_level=1)


def packed(array: np.ndarray) -> bytes:
    """An array's bytes, compressed, behind their length."""
    raw = np.ascontiguousarray(array).tobytes()
    return len(raw).to_bytes(8, "little") + (_zstd.compress(raw, asbytes=True) if raw else b"")


def unpacked(blob: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(_zstd.decompress(blob[8:], n) if n else b"", dtype)


def strings_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.large_string()))


WORD1 = np.zeros(256, bool)
WORD1[0x30:0x3A] = WORD1[0x61:0x7B] = WORD1[0x80:] = True


def alnum_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of digits, letters and non-ASCII: hashes, starts and ends."""
    low = LOWER[buf]
    start, end = runs(WORD1[low], off)
    return span_hash(prefix_hash(low), start, end), start, end


SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
