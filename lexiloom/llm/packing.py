"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most the sequence length. Only the number of
pieces of each length (a table of at most seq_len rows) comes to the driver;
there the best-two-fit rule packs lengths, not documents: a bin is filled
greedily with the largest length that fits, then its smallest length is replaced
by two that fill the widened gap more tightly. A bin pattern is used as often as
its lengths allow, so the plan stays small at any corpus size. Each piece then
finds its place from its rank among the pieces of its length; ranks are dealt in
buckets, so pieces of the commonest length are never gathered in one task.

Defined results: a null or empty text is the one-token piece of the end id;
repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise, shuffle_partitions

SEQ_LEN = 2048
#: Pieces that are ranked together, over all lengths.
BUCKET_PIECES = 100_000
END_ID = 0

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Fixed value: the split pattern of byte-level tokenisers that split words as " ?letters+".
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def fast_encoder(path: str):
    """A tiktoken encoder with the vocabulary of a tokenizers file, or None if the file's rules differ from it.

    The same ids result where the file is plain byte-level BPE and its merges stand in the order of their ids.
    """
    import json

    import tiktoken

    spec = json.loads(open(path, encoding="utf-8").read())
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
    plain &= spec.get("normalizer") is None and all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    if not plain or ids != sorted(ids) or -1 in ids or any(any(c.isspace() for c in t) for t in special):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


class ChunkTokenizer:
    """Token ids of whole texts by way of their distinct chunks.

    A byte-level tokeniser that splits words as " ?letters+" never joins a blank
    to a visible character before it. So a text may be cut before each space or
    newline that follows a visible ASCII (or Latin-1) character, and every
    distinct chunk of a slice is encoded once. Chunks are told apart by 64-bit
    hash and length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.fast = fast_encoder(path)
        self.tokenizer = Tokenizer.from_file(path)

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
        special = self.fast.special_tokens_set
        return [self.fast.encode(c, allowed_special="all") if "<" in c and any(t in c for t in special) else self.fast.encode_ordinary(c) for c in chunks]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each document."""
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        blank = (buf == 32) | (buf == 10)
        seen = (buf > 32) & (buf < 127)
        seen[1:] |= (buf[1:] >= 128) & (buf[:-1] == 0xC3)
        cut[1:n] = blank[1:] & seen[:-1]
        cut[off] = True
        cut[n] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        hashes = K.span_hash(K.prefix_hash(buf), start, end) + (end - start).astype(np.uint64)
        _, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        new = self.encode_chunks([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
        size = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for x in new for i in x), np.uint32, int(size.sum()))
        per_chunk = size[back]
        ids = flat[K.spread((np.cumsum(size) - size)[back], per_chunk)]
        total = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, np.diff(total[np.searchsorted(start, off)])


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def tokens_of(column, path: str):
    """(ids with the end id, number of ids) of each document of an Arrow text column."""
    buf, off = K.text_bytes(column)
    encoder = chunk_tokenizer(path)
    for i, j in K.slices(off):
        ids, per = encoder.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        edges = np.concatenate([[0], np.cumsum(per)])
        for k in range(j - i):
            yield np.append(ids[edges[k] : edges[k + 1]], np.uint32(END_ID)).astype("<u4")


def pieces_of(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes the remainder."""
    head = n % seq_len
    cuts = ([(0, head)] if head else []) + [(s, seq_len) for s in range(head, n, seq_len)]
    return cuts


def _piece_batches(path, seq_len, with_ids):
    def run(batches):
        for batch in batches:
            out = []
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens_of(batch.column(1), path), strict=True):
                for k, (start, length) in enumerate(pieces_of(len(ids), seq_len)):
                    own = ids[start : start + length]
                    out.append((doc_id, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] * with_ids)))
                if with_ids and len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def tokenize(documents: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most seq_len ids (each document ends with END_ID), with their ids where asked for."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_piece_batches(tokenizer, seq_len, with_ids), PIECE_SCHEMA + ", ids array<int>" * with_ids)


def best_two_fit(counts: dict[int, int], seq_len: int) -> list[tuple[int, list[int]]]:
    """(times, lengths of the bin) patterns that pack counts[length] pieces of each length."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    plan = []
    while lengths:
        used: dict[int, int] = {}
        fill: list[int] = []

        def free(x, used=used):
            return left[x] - used.get(x, 0)

        def largest(limit):
            i = bisect_right(lengths, limit) - 1
            while i >= 0 and free(lengths[i]) <= 0:
                i -= 1
            return lengths[i] if i >= 0 else 0

        def take(x, used=used, fill=fill):
            used[x] = used.get(x, 0) + 1
            fill.append(x)

        gap = seq_len
        while gap and (x := largest(gap)):
            take(x)
            gap -= x
        if gap and len(fill) > 1:
            small = fill[-1]
            room, best = gap + small, (small, 0, 0)
            for a in reversed(lengths[: bisect_right(lengths, room)]):
                if 2 * a <= best[0]:
                    break
                if free(a) <= 0:
                    continue
                used[a] = used.get(a, 0) + 1
                b = largest(min(a, room - a))
                used[a] -= 1
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
            if best[1]:
                fill.pop()
                used[small] -= 1
                take(best[1])
                take(best[2])
        times = min(left[x] // n for x, n in used.items() if n)
        plan.append((times, fill))
        for x, n in used.items():
            left[x] -= n * times
        lengths = [x for x in lengths if left[x]]
    return plan


def places(plan: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): ranks of a length go to consecutive sequences."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, fill in plan:
        offset = 0
        for x in fill:
            at = taken.get(x, 0)
            rows.append((x, at, at + times, sequence, offset))
            taken[x] = at + times
            offset += x
        sequence += times
    return rows


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """pieces with sequence_id and offset. pieces has doc_id, piece and length (1 to seq_len)."""
    spark = pieces.sparkSession
    # what follows reads the pieces more than once and must see the same rows
    buckets = max(shuffle_partitions(pieces), -(-pieces.count() // BUCKET_PIECES))
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = materialise(bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most seq_len rows
    plan = spark.createDataFrame(places(best_two_fit(counts, seq_len)), "_length bigint, _from bigint, _to bigint, _sequence bigint, offset bigint")
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = bucketed.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    # the plan has at most a few patterns for each of seq_len lengths
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")).drop("_bucket", "_own", "_before", "_rank", "_length", "_from", "_to", "_sequence")


def pack_documents(documents: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in which sequence."""
    pieces = materialise(tokenize(documents, tokenizer, seq_len, with_ids))
    packed = pack(pieces, seq_len)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * with_ids))
