"""Exact substring dedup: bytes covered by a string of LENGTH bytes that starts anywhere else too.

Blockwise suffix sorting with difference covers. D is a perfect difference set
modulo v: for any two positions there is a shift under v that brings both into the
cover. So of two equal strings, cover positions at one shift see equal windows.

1. Candidates. Windows at cover positions of the corpus are sorted bucket by
   bucket. Only suffixes less than v bytes before two repeated ones that are v bytes
   apart can have an equal among the others. Fingerprints of their prefixes are
   sorted in the same way and leave those that tie. Neither step loses a pair.
2. Blocks. Stretches of candidate suffixes that share the least hash of their inner
   16-byte strings go, with their bytes, to the block of that hash, so equal
   prefixes meet in one block. Equal stretches are folded into one before.
3. Sorting. Each block ranks its own cover samples by doubling, sorts its suffixes
   by their first bytes, and resolves the ties by the samples' ranks at the shift
   that the two positions share (block_ties). The block decides: a suffix without
   an equal there is refuted, and what is refuted goes back to the segments.
Whole texts that are equal (by 128-bit digests) are found first, and only one of
them takes part. Memory follows the block, whose size follows the bytes of the
candidates and the number of blocks.

n_shared tells more loosely how many bytes those repeated windows cover. Every
string of window + v - 1 bytes (267) that stands elsewhere too holds one of them: a
passage of fifty-odd short words has under LENGTH bytes and isn't removed, but it is
counted there.

Defined results: null and empty texts have no bytes and lose none; a text under
LENGTH bytes loses none; equal texts of LENGTH bytes or more lose all bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .segments import Segment, bucket_count, copies_of, equal_texts, make_segments, repeat_flags, repeats, rows_of
from .store import materialise, shuffle_partitions

LENGTH = 400
#: The covers of the corpus and of a block, by the primes they are made from, and the bytes of fingerprints that are compared.
COVER_FIELD, BLOCK_FIELD = 11, 5
WIDTH = 7
#: Bytes of the strings whose least hash tells the block, and bytes of candidates for a block.
GRAM = 16
BLOCK_BYTES = 1 << 20
#: Starts of a stretch at most.
MOST_STARTS = 4_096

RESULT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_shared bigint, kept binary"


@lru_cache
def difference_cover(q: int = COVER_FIELD) -> tuple[np.ndarray, int]:
    """A perfect difference set modulo q^2+q+1 for a prime q.

    The zeros of a linear recurrence of order three with the full period q^3-1
    fall on q+1 residues that form one.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                s = [0, 0, 1]
                for _ in range(v):
                    s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
                zeros = [i for i in range(v) if s[i] == 0]
                if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
                    return np.array(zeros), v
    raise ValueError(f"no cover for {q}")


def cover_for(length: int) -> tuple[np.ndarray, int, int]:
    """(residues, modulus, window) for strings of length bytes: two windows that are a modulus apart fit in at any shift."""
    for q in (COVER_FIELD, 7, 5, 3, 2):
        if 3 * (q * q + q + 1) <= length:
            cover, v = difference_cover(q)
            return cover, v, length - 2 * v + 1
    raise ValueError("length must be at least 21")


# 1. candidates


def _sample_places(segment: Segment, take: np.ndarray, cover: np.ndarray, v: int, window: int) -> np.ndarray:
    """Cover positions of the documents in take, as places in the segment."""
    places = []
    for d in np.flatnonzero(take):
        n = int(segment.lengths[d]) - window + 1
        own = (np.arange(0, n, v)[:, None] + cover).ravel()
        places.append(own[own < n] + segment.off[d])
    return np.concatenate(places) if places else np.zeros(0, np.int64)


def _samples(segment: Segment, length: int) -> tuple[np.ndarray, np.ndarray]:
    cover, v, window = cover_for(length)
    at = _sample_places(segment, (segment.lengths >= window) & copies_of(segment)[1], cover, v, window)
    return at, K.span_hash(K.prefix_hash(segment.bytes), at, at + window) if len(at) else np.zeros(0, np.uint64)


def _covered(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places in any [low, high)."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step)[:-1] > 0


def _runs(mask: np.ndarray, segment: Segment) -> bytes | None:
    """The runs of True inside documents, or None if there are none."""
    start, end = K.runs(mask, segment.off)
    return K.packed(np.concatenate([start, end])) if len(start) else None


def _run_places(blob) -> np.ndarray:
    if blob is None:
        return np.zeros(0, np.int64)
    start, end = K.unpacked(blob, np.int64).reshape(2, -1)
    return K.spread(start, end - start)


def _candidates(length, buckets):
    """Runs of the starts whose prefix can be repeated, and of the bytes in repeated samples."""
    _, v, window = cover_for(length)

    def run(batches):
        for row in rows_of(batches):
            segment = Segment(row)
            size = int(segment.off[-1])
            at, keys = _samples(segment, length)
            at = at[repeat_flags(keys, row["samples"], buckets)[0]]
            if not len(at):
                continue
            again = np.zeros(size + v, bool)
            again[at] = True
            chain = at[again[at + v]]
            doc = np.searchsorted(segment.off, chain, side="right") - 1
            low = np.maximum(chain - v + 1, segment.off[doc])
            high = np.minimum(chain, segment.off[doc] + segment.lengths[doc] - length) + 1
            good = high > low
            runs = _runs(_covered(size, low[good], high[good]), segment)
            columns = [pa.array([row["seg"]], pa.int64()), pa.array([runs], pa.binary()), pa.array([_runs(_covered(size, at, at + window), segment)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seg", "runs", "shared"])

    return run


def _prefixes(length):
    """Fingerprints of the prefixes of the suffixes that start in runs."""

    def keys(row):
        at = _run_places(row["runs"])
        return K.span_hash(K.prefix_hash(Segment(row).bytes), at, at + length) if len(at) else np.zeros(0, np.uint64)

    return keys


def _tied(length, buckets):
    """Runs of the starts whose prefix fingerprints tie."""
    keys_of = _prefixes(length)

    def run(batches):
        for row in rows_of(batches):
            segment = Segment(row)
            at = _run_places(row["runs"])
            tied = np.zeros(int(segment.off[-1]), bool)
            tied[at[repeat_flags(keys_of(row), row["strings"], buckets)[0]]] = True
            if runs := _runs(tied, segment):
                columns = [pa.array([row["seg"]], pa.int64()), pa.array([runs], pa.binary()), pa.array([int(tied.sum())], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["seg", "runs", "n_starts"])

    return run


# 2. blocks


def least_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """For every start in the runs [start, end) the least hash of the GRAM-byte strings inside its first length bytes."""
    gram = min(GRAM, length)
    size = end - start + length - gram
    places = K.spread(start, size)
    prefix = K.prefix_hash(buf)
    least, have, width = K.span_hash(prefix, places, places + gram), 1, length - gram + 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    return least[K.spread(np.cumsum(size) - size, end - start)]


def stretches(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(block hash, first start, number of starts, bytes) of the stretches of a segment's candidates."""
    buf = Segment(row).bytes
    start, end = K.unpacked(row["runs"], np.int64).reshape(2, -1)
    least, at = least_hashes(buf, start, end, length), K.spread(start, end - start)
    new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)))
    # what repeats one short string over and over comes in pieces that are equal
    size = np.diff(np.append(new, len(at)))
    pieces = -(-size // MOST_STARTS)
    new = np.repeat(new, pieces) + MOST_STARTS * K.spread(np.zeros(len(pieces), np.int64), pieces)
    count = np.diff(np.append(new, len(at)))
    raw = buf.tobytes()
    return K.mix(least[new]), at[new], count, [raw[a : a + n + length - 1] for a, n in zip(at[new].tolist(), count.tolist(), strict=True)]


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _stretch_rows(length, blocks):
    """(block, digest, n, content) of the stretches, equal ones of a segment once."""

    def run(batches):
        for row in rows_of(batches):
            hashes, _, _, contents = stretches(row, length)
            block = ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
            seen: dict[bytes, list] = {}
            for b, content in zip(block.tolist(), contents, strict=True):
                seen.setdefault(_digest(content), [b, 0, content])[1] += 1
            columns = zip(*((b, d, n, c) for d, (b, n, c) in seen.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["block", "digest", "n", "content"])

    return run


# 3. sorting


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(text)]
    return out


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows, in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        sorted_ = c[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(words: np.ndarray, cover: np.ndarray, v: int, depth: int) -> tuple[np.ndarray, int]:
    """Ranks of the strings at all cover positions (a row for every v places), and their length: depth or up to v-1 less.

    Strings grow by shifts that are multiples of v, so what a sample is extended by is a sample's too.
    """
    rows = -(-len(words) // v)
    places = np.minimum(np.arange(rows)[:, None] * v + cover, len(words) - 1)
    head = [words[np.minimum(places + 8 * k, len(words) - 1)].ravel() for k in range(4)]
    ranks, have = _names(*head).reshape(rows, len(cover)), 32
    while shift := min(have, depth - have) // v * v:
        more = np.concatenate([ranks[shift // v :], np.zeros((min(shift // v, rows), len(cover)), np.int64)])
        ranks = _names(ranks.ravel(), more.ravel()).reshape(rows, len(cover))
        have += shift
    return ranks, have


@lru_cache
def _shifts(q: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each residue of the cover, and for two residues the least shift that brings both into it."""
    cover, v = difference_cover(q)
    column = np.full(v, -1)
    column[cover] = np.arange(len(cover))
    first = lambda a, b: next(d for d in range(v) if column[(a + d) % v] >= 0 and column[(b + d) % v] >= 0)
    return column, np.array([[first(a, b) for b in range(v)] for a in range(v)])


def block_ties(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix at starts has the first length bytes in common with another of them; these bytes lie inside text."""
    if not len(starts):
        return np.zeros(0, bool)
    words = _words(text)
    cover, v = difference_cover(BLOCK_FIELD)
    if length < 128:  # no room for samples: compare all words
        group = _names(*(words[starts + k] for k in (*range(0, length - 8, 8), length - 8)))
        return np.bincount(group)[group] > 1
    ranks, depth = sample_ranks(words, cover, v, length - v + 1)
    # equal in the first 32 and the last 64 bytes; the samples' strings reach from one to the other at any shift
    group = _names(*(words[starts + k] for k in (0, 8, 16, 24, *range(length - 64, length, 8))))
    column, shift = _shifts(BLOCK_FIELD)
    rank_at = lambda p: ranks[p // v, column[p % v]]
    tied = np.zeros(len(starts), bool)
    open_ = np.argsort(group, kind="stable")
    while len(open_):
        first = np.append(True, group[open_[1:]] != group[open_[:-1]])
        lead = open_[np.flatnonzero(first)][np.cumsum(first) - 1]
        a, b = starts[open_], starts[lead]
        d = shift[a % v, b % v]
        same = rank_at(a + d) == rank_at(b + d)
        other = open_[same & ~first]
        tied[other] = True
        tied[lead[same & ~first]] = True
        open_ = open_[~same]
    return tied


def _sort_block(length):
    """The contents of a block that hold starts without an equal, with one bit for each start."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("digest")
        contents, times = table["content"].to_pylist(), np.asarray(table["n"].combine_chunks())
        size = np.array([len(c) for c in contents], np.int64)
        count = size - length + 1
        starts = K.spread(np.cumsum(size) - size, count)
        good = block_ties(np.frombuffer(b"".join(contents), np.uint8), starts, length) | np.repeat(times > 1, count)
        ends = np.cumsum(count)
        wrong = [k for k in range(len(contents)) if not good[ends[k] - count[k] : ends[k]].all()]
        bits = [np.packbits(good[ends[k] - count[k] : ends[k]]).tobytes() for k in wrong]
        digests = table["digest"].to_pylist()
        return pa.table([pa.array([digests[k] for k in wrong], pa.binary()), pa.array(bits, pa.binary())], names=["digest", "good"])

    return run


def _stretch_digests(length):
    def run(batches):
        for row in rows_of(batches):
            digests = sorted({_digest(c) for c in stretches(row, length)[3]})
            yield pa.RecordBatch.from_arrays([pa.array([row["seg"]] * len(digests), pa.int64()), pa.array(digests, pa.binary())], names=["seg", "digest"])

    return run


def refuted(candidates: DataFrame, length: int) -> DataFrame:
    """(seg, refuted) of segments with stretches that hold a start whose prefix occurs nowhere else, after all."""
    total = candidates.agg(F.sum("n_starts")).first()[0] or 0
    blocks = max(4 * shuffle_partitions(candidates), -(-int(total) // BLOCK_BYTES))
    rows = candidates.mapInArrow(_stretch_rows(length, blocks), "block int, digest binary, n bigint, content binary")
    once = rows.groupBy("block", "digest").agg(F.sum("n").alias("n"), F.first("content").alias("content"))
    wrong = materialise(once.groupBy("block").applyInArrow(_sort_block(length), "digest binary, good binary"))
    if wrong.isEmpty():
        return candidates.sparkSession.createDataFrame([], "seg bigint, refuted array<struct<digest:binary,good:binary>>")
    owners = candidates.mapInArrow(_stretch_digests(length), "seg bigint, digest binary")
    return owners.join(wrong, "digest").groupBy("seg").agg(F.collect_list(F.struct("digest", "good")).alias("refuted"))


def _confirmed(row: dict, length: int) -> np.ndarray:
    """Starts whose prefixes the blocks found elsewhere too."""
    at = _run_places(row["runs"])
    if not row["refuted"]:
        return at
    wrong = {x["digest"]: x["good"] for x in row["refuted"]}
    _, _, count, contents = stretches(row, length)
    bits = [np.unpackbits(np.frombuffer(wrong[d], np.uint8), count=n).astype(bool) if (d := _digest(c)) in wrong else np.ones(n, bool) for c, n in zip(contents, count.tolist(), strict=True)]
    return at[np.concatenate(bits)]


def _results(length, with_text):
    def run(batches):
        for row in rows_of(batches):
            segment = Segment(row)
            buf = segment.bytes
            at = _confirmed(row, length)
            gone, near = _covered(len(buf), at, at + length), np.zeros(len(buf), bool)
            near[_run_places(row["shared"])] = True
            same = copies_of(segment)[0]
            for d in np.flatnonzero(same):
                gone[segment.off[d] : segment.off[d + 1]] = True
            near |= gone
            first, _ = K.runs(gone, segment.off)
            spans = np.diff(np.searchsorted(first, segment.off))
            out = []
            for d, doc_id in enumerate(segment.doc_ids):
                own = slice(segment.off[d], segment.off[d + 1])
                kept = buf[own][~gone[own]].tobytes()
                out.append((doc_id, int(segment.lengths[d]), int(segment.lengths[d]) - len(kept), int(spans[d]), hashlib.sha256(kept).hexdigest(), int(near[own].sum()), kept if with_text else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared", "kept"])

    return run


def remove_repeated_substrings(documents: DataFrame, length: int = LENGTH, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: bytes, bytes removed, maximal removed runs, the SHA-256 of what is kept and bytes shared (with_text: the kept bytes too)."""
    segments = make_segments(documents, id_col, text_col)
    buckets = bucket_count(segments)
    marked = segments.join(materialise(equal_texts(segments, length)), "seg", "left")
    samples = repeats(marked, lambda row: _samples(Segment(row), length)[1], buckets, width=WIDTH, reply="samples")
    found = materialise(marked.join(samples, "seg").mapInArrow(_candidates(length, buckets), "seg bigint, runs binary, shared binary"))
    near = segments.drop("digests").join(found.where("runs is not null").select("seg", "runs"), "seg")
    strings = repeats(near, _prefixes(length), buckets, width=WIDTH, reply="strings")
    tied = materialise(near.join(strings, "seg").mapInArrow(_tied(length, buckets), "seg bigint, runs binary, n_starts bigint"))
    wrong = refuted(segments.drop("digests").join(tied, "seg"), length)
    rows = marked.join(tied.drop("n_starts"), "seg", "left").join(found.select("seg", "shared"), "seg", "left").join(wrong, "seg", "left")
    out = rows.mapInArrow(_results(length, with_text), RESULT_SCHEMA)
    return out if with_text else out.drop("kept")


def oracle_sql(length: int = LENGTH) -> str:
    """The contract in SQL: all strings of length bytes of all documents, and for n_shared all windows at cover positions."""
    cover, v, window = cover_for(length)
    return f"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, i, md5(array_slice(b, i + 1, i + {length})) AS h FROM s, unnest(range(0, n - {length - 1})) AS u(i)),
st AS (SELECT r, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
m AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {length} THEN 0 ELSE 1 END AS new FROM st),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
runs AS (SELECT r, min(i) AS a, max(i) + {length} AS z FROM g GROUP BY r, k),
cuts AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT r, max(z), any_value(n) FROM runs JOIN s USING (r) GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN y > x THEN hex(array_slice(b, x + 1, y)) ELSE '' END, '' ORDER BY x) AS t FROM cuts JOIN s USING (r) GROUP BY r),
own AS (SELECT r, b, n FROM s WHERE n < {length} UNION ALL SELECT min(r), b, any_value(n) FROM s WHERE n >= {length} GROUP BY b),
c AS (SELECT r, i, md5(array_slice(b, i + 1, i + {window})) AS h FROM own, unnest(range(0, n - {window - 1})) AS u(i) WHERE i % {v} IN ({", ".join(map(str, cover.tolist()))})),
cs AS (SELECT r, i AS a, i + {window} AS z FROM c SEMI JOIN (SELECT h FROM c GROUP BY h HAVING count(*) > 1) USING (h) UNION ALL SELECT r, a, z FROM runs),
cm AS (SELECT r, a, z, max(z) OVER (PARTITION BY r ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cs),
shared AS (SELECT r, sum(greatest(z - greatest(a, coalesce(before, 0)), 0))::BIGINT AS n_shared FROM cm GROUP BY r),
total AS (SELECT r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN t IS NULL THEN sha256(b) ELSE sha256(unhex(t)) END AS kept_sha256, coalesce(n_shared, 0)::BIGINT AS n_shared
FROM s LEFT JOIN total USING (r) LEFT JOIN kept USING (r) LEFT JOIN shared USING (r)
"""
