"""Benchmark decontamination with a positional inverted index over the training documents.

The index is partitioned by document: each row is a segment of about 2 MB of
text and holds, for every term in it, the sorted list of its positions. The
benchmark is a stated query set. It is read in blocks of bounded size, one at a
time, and each block is searched against every segment: the position lists of a
window's terms are intersected, adjusted by the term's offset, from the rarest term
on. Nothing is shuffled by term, so a frequent word or a hot source makes no hot task.

Defined results: a null or empty text has no words; an item without words has no
window; rows that repeat (equal doc_id, equal text) are answered one by one; an
item with a null item_id marks words but is not listed; columns other than the
named ones are ignored, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise

WINDOW = 10
#: Positions between documents: no window and no allowed slop reaches over it.
GAP = 1 << 10
BLOCK_WINDOWS = 200_000
#: Words that a term of a proximity match may stand off its place.
SLOP = 2

INDEX_SCHEMA = "doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, postings binary"
MATCH_SCHEMA = "segment bigint, row int, doc_id bigint, n_words bigint, spans array<struct<first:int,last:int>>, items array<string>, near array<string>"


def _index_batches(batches):
    for batch in batches:
        ids = batch.column(0)
        buf, off = K.text_bytes(batch.column(1))
        for i, j in K.slices(off):
            part, own = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            hashes, start, _ = K.alnum_words(part, own)
            words = np.diff(np.searchsorted(start, own))
            at = np.arange(len(start), dtype=np.int64) + GAP * np.repeat(np.arange(j - i), words)
            order = np.argsort(hashes, kind="stable")
            terms, first = np.unique(hashes[order], return_index=True)
            counts = np.diff(np.append(first, len(order))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), *(pa.array([K.packed(x)], pa.binary()) for x in (terms, counts, at[order].astype(np.int32)))],
                names=["doc_ids", "n_words", "terms", "counts", "postings"],
            )


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Position lists of all terms of all documents, stored in the checkpoint folder, one row a segment."""
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = rows.mapInArrow(_index_batches, INDEX_SCHEMA)
    return materialise(index.withColumn("segment", F.monotonically_increasing_id()))


class Windows:
    """A block of benchmark windows: distinct term sequences and the items that own them."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        ids = [str(i) if i is not None else None for i, _ in items]
        hashes, start, _ = K.alnum_words(*K.strings_bytes([t for _, t in items]))
        off = K.strings_bytes([t for _, t in items])[1]
        edges = np.searchsorted(start, off)
        owners: dict[bytes, set] = {}
        for k, item in enumerate(ids):
            own = hashes[edges[k] : edges[k + 1]]
            for p in range(max(len(own) - width + 1, min(len(own), 1))):
                owners.setdefault(own[p : p + width].tobytes(), set()).add(item)
        self.items = [sorted(x for x in who if x is not None) for who in owners.values()]
        self.length = np.array([len(x) // 8 for x in owners], np.int64)
        self.terms = np.zeros((len(owners), width), np.uint64)
        for k, x in enumerate(owners):
            self.terms[k, : len(x) // 8] = np.frombuffer(x, np.uint64)
        self.vocabulary = np.unique(self.terms[np.arange(width) < self.length[:, None]])
        self.at = np.searchsorted(self.vocabulary, self.terms).clip(max=max(len(self.vocabulary) - 1, 0))


def intersect(windows: Windows, terms: np.ndarray, counts: np.ndarray, postings: np.ndarray, rarest: int | None = None, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(start position, window) of every occurrence in a segment.

    The rarest term of a window gives the candidate starts; each further term, by
    rising count, keeps the starts with a posting at its offset, give or take slop.
    With a slop a start is any place that all terms are so near to; it may lie before the text.
    rarest limits how many terms have to be near (None: all of them).
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(terms) or not len(windows.vocabulary):
        return none
    place = np.searchsorted(terms, windows.vocabulary).clip(max=len(terms) - 1)
    found = terms[place] == windows.vocabulary
    width = windows.terms.shape[1]
    real = np.arange(width) < windows.length[:, None]
    live = np.flatnonzero((found[windows.at] | ~real).all(axis=1))
    if not len(live):
        return none
    place, real = place[windows.at[live]], real[live]
    rarity = np.where(real, counts[place].astype(np.int64), np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    first = np.cumsum(counts.astype(np.int64)) - counts
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) + postings
    rows = np.arange(len(live))
    lead = place[rows, order[:, 0]]
    which = np.repeat(rows, counts[lead])
    start = postings[K.spread(first[lead], counts[lead].astype(np.int64))].astype(np.int64) - order[which, 0]
    if slop:
        # the rarest term too may stand off its place
        off = np.arange(-slop, slop + 1)
        which, start = np.repeat(which, len(off)), (start[:, None] + off).ravel()
    else:
        which, start = which[start >= 0], start[start >= 0]
    for k in range(1, min(width, rarest or width)):
        offset = order[which, k]
        wanted = (place[which, offset].astype(np.int64) << 32) + start + offset
        at = np.searchsorted(keys, wanted - slop).clip(max=len(keys) - 1)
        good = ~real[which, offset] | ((keys[at] >= wanted - slop) & (keys[at] <= wanted + slop))
        which, start = which[good], start[good]
    return start, live[which]


def _items_of(query: Windows, doc: np.ndarray, window: np.ndarray, n: int) -> list[list[str]]:
    """The items of the windows found in each of n documents."""
    order = np.argsort(doc, kind="stable")
    doc, window = doc[order], window[order]
    edges = np.searchsorted(doc, np.arange(n + 1))
    return [sorted({x for w in np.unique(window[a:b]) for x in query.items[w]}) if b > a else [] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _search(windows, rarest, slop, near):
    def run(batches):
        query = windows.value
        for batch in batches:
            for row in batch.to_pylist():
                index = K.unpacked(row["terms"], np.uint64), K.unpacked(row["counts"], np.int32), K.unpacked(row["postings"], np.int32)
                start, window = intersect(query, *index, rarest, slop)
                words = np.array(row["n_words"], np.int64)
                base = np.cumsum(words) - words + GAP * np.arange(len(words))
                doc = np.searchsorted(base, start + slop, side="right") - 1
                spans, items = [None] * len(words), _items_of(query, doc, window, len(words))
                nearby = items
                if near is not None:
                    at, other = intersect(query, *index, None, near)
                    # the first term may stand before the document's first word by the slop
                    owner = np.searchsorted(base, at + near, side="right") - 1
                    nearby = _items_of(query, owner, other, len(words))
                order = np.lexsort((start, doc))
                start, window, doc = start[order], window[order], doc[order]
                edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    d = int(doc[a])
                    lo = start[a:b] - base[d]
                    hi = np.minimum(lo + query.length[window[a:b]], words[d])
                    lo = np.maximum(lo, 0)
                    reach = np.maximum.accumulate(hi)
                    new = np.append(True, lo[1:] > reach[:-1])
                    ends = reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]
                    spans[d] = [{"first": int(x), "last": int(y)} for x, y in zip(lo[new], ends, strict=True)]
                n = len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(words, pa.int64()), pa.array([x or [] for x in spans], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string())), pa.array(nearby, pa.list_(pa.string()))],
                    names=["segment", "row", "doc_id", "n_words", "spans", "items", "near"],
                )

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, limit: int):
    """The benchmark's windows in blocks of at most about limit windows."""
    held, size, empty = [], 0, True
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") // 2 + 1
        if size >= limit:
            yield Windows(held, width)
            held, size = [], 0
            empty = False
    if held or empty:
        yield Windows(held, width)


def find_matches(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, rarest: int | None = None, slop: int = 0, block: int = BLOCK_WINDOWS, near: int | None = None) -> DataFrame:
    """One row per document: matched word spans [first, last), the items they match, and those that match with a slop of near.

    slop 0 and rarest None give exact phrases. With slop s and rarest r a window
    matches where its r rarest terms stand within s words of their places
    (proximity); its span then is where the phrase would stand. All of a window's
    terms have to stand in the segment.
    """
    if max(slop, near or 0) >= GAP - width:
        raise ValueError(f"slop must be under {GAP - width}")
    context = index.sparkSession.sparkContext
    blocks = _blocks(benchmark, id_col, text_col, width, block)
    shared = context.broadcast(next(blocks))
    whole = index.mapInArrow(_search(shared, rarest, slop, near), MATCH_SCHEMA)
    more = False
    for windows in blocks:
        # a block's result is stored before the next one is read, so one block at a time is held
        if not more:
            whole, more = materialise(whole), True
        shared.destroy()
        shared = context.broadcast(windows)
        whole = whole.unionByName(materialise(index.mapInArrow(_search(shared, rarest, slop, near), MATCH_SCHEMA)))
    if not more:
        return whole
    whole = whole.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")))
    empty = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    close = lambda s: F.when(s["last"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["first"], s["last"]))))
    joined = F.aggregate(
        "spans",
        empty,
        lambda s, x: F.when(x["first"] <= s["last"], F.struct(s["done"].alias("done"), s["first"].alias("first"), F.greatest(s["last"], x["last"]).alias("last"))).otherwise(F.struct(close(s).alias("done"), x["first"].alias("first"), x["last"].alias("last"))),
        close,
    )
    return whole.withColumn("spans", joined)


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WINDOW, block: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: words, words inside exact matches, matched items, whether any word is hit, and items matched by proximity (n_near)."""
    found = find_matches(build_index(documents), benchmark, width=width, block=block, near=SLOP)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.size("near").cast("bigint").alias("n_near"),
        "spans",
    )


def oracle_sql(width: int = WINDOW) -> str:
    """The contract in SQL: all windows of all documents joined with those of the items."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), {width}) AS n, array_to_string(w[i:i + least(len(w), {width}) - 1], ' ') AS s
        FROM b, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS u(i) WHERE len(w) > 0),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM win) AS z, unnest(range(1, len(w) - n + 2)) AS u(i)),
h AS (SELECT r, i, n, item FROM dw JOIN win USING (s, n)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r),
seq AS (SELECT s, any_value(n) AS n, string_split(s, ' ') AS t FROM win GROUP BY s),
pos AS (SELECT r, i AS p, w[i] AS term FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
freq AS (SELECT term, count(*) AS f FROM pos GROUP BY term),
parts AS (SELECT s, n, i AS k, t[i] AS term FROM seq, unnest(range(1, n + 1)) AS u(i)),
lead AS (SELECT s, n, arg_min(k, (f, k)) AS k, arg_min(term, (f, k)) AS term FROM parts JOIN freq USING (term) GROUP BY s, n HAVING count(*) = n),
starts AS (SELECT DISTINCT r, s, n, p - k + e AS b FROM lead JOIN pos USING (term), unnest(range(-{SLOP}, {SLOP} + 1)) AS u(e)),
close AS (SELECT DISTINCT r, s FROM (SELECT a.r, a.s, a.n, a.b FROM starts a JOIN parts USING (s) JOIN pos q ON q.r = a.r AND q.term = parts.term AND q.p BETWEEN a.b + parts.k - {SLOP} AND a.b + parts.k + {SLOP} GROUP BY ALL HAVING count(DISTINCT parts.k) = a.n)),
z AS (SELECT r, count(DISTINCT item) AS n_near FROM close JOIN win USING (s) WHERE item IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r) LEFT JOIN z USING (r)
"""
