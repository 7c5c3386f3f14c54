"""Segments of about 2 MB of whole texts, and the search for hashes that occur more than once.

A segment is one row with its documents' ids, lengths and compressed bytes. It is
stored in the checkpoint folder, dealt by its number, so that later joins on the
number move only the small side. repeats() tells every segment which of its 64-bit
keys occur elsewhere: sorted unique keys are cut into ranges, one blob per segment
and range, each range is sorted by one task at a time, and only bits come back. A
key that fills a third of all documents sends one entry per segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import kernels as K
from .store import materialise_by, shuffle_partitions

SEGMENT_SCHEMA = "doc_ids array<bigint>, lengths binary, digests binary, text binary"
#: A segment's keys are under 2 MB, so a bucket's are under 32.
SEGMENTS_A_BUCKET = 16


def _segment_batches(batches):
    for batch in batches:
        ids = batch.column(0)
        carried = batch.column(2) if batch.num_columns > 2 else None
        buf, off = K.text_bytes(batch.column(1))
        for i, j in K.slices(off):
            part, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            raw = part.tobytes()
            digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(own[:-1], own[1:], strict=True))
            columns = [pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), *(pa.array([K.packed(x)], pa.binary()) for x in (np.diff(own), np.frombuffer(digests, np.uint8), part))]
            if carried is not None:
                columns.append(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), carried.slice(i, j - i)))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_ids", "lengths", "digests", "text", "carried"][: len(columns)])


def make_segments(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Segments of documents; the columns in carry go along, one struct per document."""
    given = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))
    schema = StructType.fromDDL(SEGMENT_SCHEMA)
    if carry:
        schema.add("carried", ArrayType(given.schema["carried"].dataType))
    return materialise_by(given.mapInArrow(_segment_batches, schema).withColumn("seg", F.monotonically_increasing_id()), "seg")


class Segment:
    """A segment row in a task."""

    def __init__(self, row: dict):
        self.row = row
        self.seg = row["seg"]
        self.doc_ids = row["doc_ids"]
        self.lengths = K.unpacked(row["lengths"], np.int64)
        self.off = np.concatenate([[0], np.cumsum(self.lengths)])

    @property
    def bytes(self) -> np.ndarray:
        return K.unpacked(self.row["text"], np.uint8)

    @property
    def digests(self) -> np.ndarray:
        """Two 64-bit numbers for each document's whole text."""
        return K.unpacked(self.row["digests"], np.uint64).reshape(-1, 2)


def rows_of(batches):
    """The rows of all batches as dicts, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _digest_rows(length):
    """(digest, seg, docs): the documents of a segment with one text, so a text of thousands of copies has one row a segment."""

    def run(batches):
        for row in rows_of(batches):
            segment = Segment(row)
            digests, docs = segment.digests, {}
            for d in np.flatnonzero(segment.lengths >= length).tolist():
                docs.setdefault(digests[d].tobytes(), []).append(d)
            yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.binary()), pa.array([row["seg"]] * len(docs), pa.int64()), pa.array(list(docs.values()), pa.list_(pa.int32()))], names=["digest", "seg", "docs"])

    return run


def equal_texts(segments: DataFrame, length: int) -> DataFrame:
    """(seg, copies): the documents of each segment whose text of length bytes or more others have too, and the first of all of them."""
    rows = segments.select("seg", "doc_ids", "lengths", "digests").mapInArrow(_digest_rows(length), "digest binary, seg bigint, docs array<int>")
    lead = F.struct("seg", F.get("docs", F.lit(0)).alias("doc"))
    first = rows.groupBy("digest").agg(F.min(lead).alias("lead"), F.sum(F.size("docs")).alias("n")).where("n > 1")
    again = rows.join(first, "digest").select("seg", F.struct("docs", (F.col("seg") == F.col("lead.seg")).alias("first"), F.col("lead.seg").alias("lead_seg"), F.col("lead.doc").alias("lead_doc")).alias("copy"))
    return again.groupBy("seg").agg(F.collect_list("copy").alias("copies"))


def copies_of(segment: Segment) -> tuple[np.ndarray, np.ndarray]:
    """For every document whether others have its text, and whether it takes part."""
    again, part = np.zeros(len(segment.lengths), bool), np.ones(len(segment.lengths), bool)
    for x in segment.row["copies"] or ():
        again[x["docs"]], part[x["docs"]] = True, False
        part[x["docs"][0]] = x["first"]
    return again, part


def _cuts(unique: np.ndarray, buckets: int) -> np.ndarray:
    limits = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(unique, limits), [len(unique)]])


def _send(keys_of, buckets, width):
    drop = np.uint64(64 - 8 * width)

    def run(batches):
        for row in rows_of(batches):
            unique, count = np.unique(keys_of(row), return_counts=True)
            cuts = _cuts(unique, buckets)
            short = (unique >> drop).view(np.uint8).reshape(-1, 8)[:, :width]
            out = [(b, row["seg"], short[x:y].tobytes(), np.packbits(count[x:y] > 1).tobytes()) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "seg", "keys", "twice"])

    return run


def _sort_bucket(width, many):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seg")
        blobs = table["keys"].to_pylist()
        size = np.array([len(x) // width for x in blobs], np.int64)
        raw = np.zeros((int(size.sum()), 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        keys = raw.view(np.uint64).ravel()
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), size, strict=True)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again, first = twice, np.zeros(len(keys), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        first[order] = np.append(True, ~same)[: len(keys)]
        starts = np.flatnonzero(np.append(True, ~same))[: len(keys)]
        holders = np.diff(np.append(starts, len(keys)))
        heat = np.zeros(len(keys), np.uint8)
        if many:
            heat[order] = np.repeat(np.where(holders >= many, np.floor(np.log2(np.maximum(holders, many) / many)) + 1, 0), holders)
        ends = np.cumsum(size)
        bits = lambda x: [np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, size, strict=True)]
        return pa.table([table["seg"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(bits(again), pa.binary()), pa.array(bits(first), pa.binary()), pa.array([K.packed(heat[e - n : e]) for e, n in zip(ends, size, strict=True)] if many else [None] * len(size), pa.binary())], names=["seg", "bucket", "again", "first", "hot"])

    return run


def repeats(segments: DataFrame, keys_of: Callable[[dict], np.ndarray], buckets: int, width: int = 8, reply: str = "replies", many: int = 0) -> DataFrame:
    """(seg, replies): what repeat_flags() needs to flag the keys of keys_of(row) that occur more than once.

    width is the number of leading bytes compared: under 8 serves as a filter that
    may flag a few keys too many, never too few. many: also tell how many times so
    many segments have a key, for hot_levels().
    """
    sent = segments.mapInArrow(_send(keys_of, buckets, width), "bucket int, seg bigint, keys binary, twice binary")
    back = sent.groupBy("bucket").applyInArrow(_sort_bucket(width, many), "seg bigint, bucket int, again binary, first binary, hot binary")
    return back.groupBy("seg").agg(F.collect_list(F.struct("bucket", "again", "first", "hot")).alias(reply))


def bucket_count(segments: DataFrame) -> int:
    """Ranges of hashes: four a shuffle partition at least, and as many as hold the keys of SEGMENTS_A_BUCKET segments each.

    So what one task sorts stays the same at every size; a segment sends no more rows than it has keys.
    """
    return max(4 * shuffle_partitions(segments), -(-segments.count() // SEGMENTS_A_BUCKET))


def _told(unique: np.ndarray, replies: list[dict] | None, buckets: int, *names: str) -> list[np.ndarray]:
    """The bits of the replies, one for each unique key."""
    cuts = _cuts(unique, buckets)
    out = [np.zeros(len(unique), bool) for _ in names]
    for x in replies or ():
        a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
        for bits, name in zip(out, names, strict=True):
            bits[a:b] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=b - a)
    return out


def repeat_flags(keys: np.ndarray, replies: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For every key: whether it occurs more than once, and whether it is here that it occurs first."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
    again, first = _told(unique, replies, buckets, "again", "first")
    leads = np.zeros(len(keys), bool)
    leads[where] = first
    return again[back], leads


def hot_levels(keys: np.ndarray, replies: list[dict] | None, buckets: int) -> np.ndarray:
    """For every key 0, or 1 where many segments have it, 2 where twice as many have it, 3 for four times, and so on."""
    unique, back = np.unique(keys, return_inverse=True)
    cuts, out = _cuts(unique, buckets), np.zeros(len(unique), np.uint8)
    for x in replies or ():
        out[cuts[x["bucket"]] : cuts[x["bucket"] + 1]] = K.unpacked(x["hot"], np.uint8)
    return out[back]
