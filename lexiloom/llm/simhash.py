"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two
fingerprints that differ in four bits or fewer have a pair of segments with two
errors or fewer in all (the worst segment takes at least two of four). A segment
is filled up to a 24-bit word of even weight; it lies at distance four from six
Golay codewords, or within two of one. Two such words at distance two always
share one of these codewords, so the numbers of a segment's near codewords are
keys that two errors can't miss. The keys of a pair of segments are combined and
joined on; candidates are verified on all 64 bits inside the join's task.

A key's fingerprints are compared in sorted streams. A key with more than BLOCK
fingerprints is dealt out as pairs of blocks, so no task holds an unbounded
group. Out of a key come only the links of a spanning forest, never all pairs.

Defined results: null and empty texts, and texts of white space only, have the
fingerprint zero and are linked like any other; equal rows share a component;
a null doc_id takes part but is never the smallest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .components import connected_components
from .store import materialise, shuffle_partitions
from .xxh64 import xxh64_spans

MAX_BITS = 4
SHINGLE = 4
BLOCK = 4096
NEAR = 16
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(buf: np.ndarray, off: np.ndarray, words: int = SHINGLE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word shingle, and how many each document has."""
    is_word = ~K.SPACE[buf]
    start, end = K.runs(is_word, off)
    per = np.diff(np.searchsorted(start, off))
    length = end - start
    # words behind one another, each followed by one space
    place = np.cumsum(length + 1) - (length + 1)
    flat = np.full(int((length + 1).sum()), 32, np.uint8)
    flat[K.spread(place, length)] = K.LOWER[buf[is_word]]
    count = np.where(per >= words, per - words + 1, np.minimum(per, 1))
    first = K.spread(np.cumsum(per) - per, count)
    last = first + np.repeat(np.minimum(per, words), count) - 1
    return (xxh64_spans(flat, place[first], place[last] + length[last], seed) if len(first) else np.zeros(0, np.uint64)), count


def fingerprints(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits set in over half of each document's hashes."""
    out = np.zeros(len(count), np.uint64)
    chunk = 60_000  # 16-bit lanes hold its sums
    cuts = -(-count // chunk)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), cuts)
    if not len(owner):
        return out
    at = first[owner] + chunk * (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    lanes = np.uint64(0x0001000100010001)
    for k in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, at)
        for lane in range(4):
            ones = np.zeros(len(count), np.int64)
            np.add.at(ones, owner, ((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64))
            out |= (2 * ones > count).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        buf, off = K.text_bytes(batch.column(1))
        parts = [fingerprints(*shingle_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in K.slices(off)]
        fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])


def with_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`") for c in carry))
    schema = StructType([*StructType.fromDDL("doc_id bigint, fp bigint"), *(rows.schema[c] for c in carry)])
    return rows.mapInArrow(_fingerprint_batches, schema)


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 12-bit syndrome: up to six nearest error patterns of even weight (24 bits), and how many.

    The code is generated by x^11+x^10+x^6+x^5+x^4+x^2+1 and a parity bit.
    """
    error = [0] + [1 << a for a in range(24)] + [(1 << a) | (1 << b) for a in range(24) for b in range(a)]
    pairs = [x for x in error if x.bit_count() != 1]
    quads = [sum(1 << x for x in (a, b, c, d)) for a in range(24) for b in range(a) for c in range(b) for d in range(c)]
    table, size = np.zeros((4096, 6), np.uint32), np.zeros(4096, np.int64)
    small = np.array(pairs, np.uint32)
    table[syndromes(small), 0], size[syndromes(small)] = small, 1
    four = np.array(quads, np.uint32)
    of = syndromes(four)
    order = np.argsort(of, kind="stable")
    of, four = of[order], four[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    table[of, rank] = four
    np.maximum.at(size, of, rank + 1)
    return table, size


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of the low 23 bits by the generator, with the parity of all 24 as top bit."""
    rest = words.astype(np.uint32) & np.uint32(0x7FFFFF)
    for k in range(22, 10, -1):
        rest = np.where((rest >> np.uint32(k)) & np.uint32(1), rest ^ np.uint32(0xC75 << (k - 11)), rest)
    return (rest | ((np.bitwise_count(words) & np.uint8(1)).astype(np.uint32) << np.uint32(11))).astype(np.int64)


def segment_keys(values: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords near each value: (rows, up to 6) and how many."""
    table, size = tables
    words = values.astype(np.uint32)
    words |= (np.bitwise_count(words) & np.uint8(1)).astype(np.uint32) << np.uint32(23)
    of = syndromes(words)
    return ((words[:, None] ^ table[of]) & np.uint32(0x7FFFFF)) >> np.uint32(11), size[of]


def golay_keys(fp: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every fingerprint: the combined keys of each pair of segments."""
    each = [segment_keys((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1), tables) for at, bits in SEGMENTS]
    rows, keys = [], []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, na), (kb, nb) = each[a], each[b]
        for i in range(6):
            for j in range(6):
                on = np.flatnonzero((na > i) & (nb > j))
                rows.append(on)
                keys.append((np.int64(pair) << 24) | (ka[on, i].astype(np.int64) << 12) | kb[on, j].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _key_batches(batches):
    tables = golay_tables()
    for batch in batches:
        whole = np.asarray(batch.column(0))
        for at in range(0, len(whole), 8192):
            fp = whole[at : at + 8192]
            rows, keys = golay_keys(fp.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def forest(fp: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that span the components of a set of fingerprints."""
    links, left = [], fp
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count((left ^ queue.pop()).view(np.uint64)) <= bits
            if near.any():
                hit = left[near]
                links += [(int(root), int(x)) for x in hit]
                queue += list(hit)
                left = left[~near]
    return links


def _link_batches(batches):
    """Links among the fingerprints of each key, from batches sorted by key; large keys come out as deferred blocks."""

    def large(key, fp, block):
        return (np.full(len(fp), 1, np.int32), np.full(len(fp), key), fp, np.full(len(fp), block, np.int64))

    def batch_of(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["kind", "key", "a", "b"])

    held_key, held, block = None, np.zeros(0, np.int64), 0

    def close():
        nonlocal held, block
        parts = []
        if block:
            parts = [large(held_key, held, block)] if len(held) else []
        elif len(held) > 1:
            links = np.array(forest(held), np.int64).reshape(-1, 2)
            parts = [(np.zeros(len(links), np.int32), np.zeros(len(links), np.int64), links[:, 0], links[:, 1])] if len(links) else []
        held, block = np.zeros(0, np.int64), 0
        return parts

    for batch in batches:
        key, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(key):
            continue
        parts = []
        cuts = np.flatnonzero(np.diff(key)) + 1
        edges = np.concatenate([[0], cuts, [len(key)]])
        size = np.diff(edges)
        # the first run may continue the last one of the batch before, the last one may go on
        inner = np.repeat((size > 1) & (size <= NEAR) & (np.arange(len(size)) > 0) & (np.arange(len(size)) < len(size) - 1), size)
        for shift in range(1, NEAR):
            i = np.flatnonzero(inner[:-shift] & (key[:-shift] == key[shift:]) & (np.bitwise_count((fp[:-shift] ^ fp[shift:]).view(np.uint64)) <= MAX_BITS)) if len(key) > shift else np.zeros(0, np.int64)
            if len(i):
                parts.append((np.zeros(len(i), np.int32), np.zeros(len(i), np.int64), fp[i], fp[i + shift]))
        for r in sorted({0, len(size) - 1, *np.flatnonzero(size > NEAR)}):
            k, own = key[edges[r]], fp[edges[r] : edges[r + 1]]
            if k != held_key:
                parts += close()
                held_key = k
            held = np.concatenate([held, own])
            while len(held) > BLOCK:
                parts.append(large(k, held[:BLOCK], block + 1))
                held, block = held[BLOCK:], block + 1
            if block and len(held):
                block += 1
                parts.append(large(k, held, block))
                held = held[:0]
        if parts:
            yield batch_of(parts)
    if parts := close():
        yield batch_of(parts)


def _block_links(table: pa.Table) -> pa.Table:
    links = np.array(forest(np.unique(np.asarray(table["fp"].combine_chunks()))), np.int64).reshape(-1, 2)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within MAX_BITS of one another."""
    keys = distinct.select("fp").mapInArrow(_key_batches, "key bigint, fp bigint")
    found = keys.repartition(shuffle_partitions(distinct), "key").sortWithinPartitions("key").mapInArrow(_link_batches, "kind int, key bigint, a bigint, b bigint")
    found = materialise(found)
    links = found.where("kind = 0").select("a", "b")
    deferred = found.where("kind = 1").selectExpr("key", "b as block", "a as fp")
    if not deferred.isEmpty():
        blocks = deferred.groupBy("key").agg(F.max("block").alias("n"))
        dealt = deferred.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(1), F.col("n"))))
        dealt = dealt.select("key", "fp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        links = links.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_block_links, "a bigint, b bigint"))
    return links.distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id it is linked with; then the columns in carry."""
    prints = materialise(with_fingerprints(documents, id_col, text_col, carry))
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(near_links(distinct))
    joined = distinct.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(F.col(f"`{c}`") for c in carry))
