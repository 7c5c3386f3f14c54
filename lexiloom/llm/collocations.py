"""Collocations: phrases whose words stand together more often than their parts let expect.

Texts of one language are gathered in shards of about 2 MB. In a shard every word
has a bitmap of its positions; between two pieces a position stays empty. Bitmaps
are compressed: blocks of 16 positions, of which only those with a bit are kept.
A phrase is extended by shifting its bitmap by one position and intersecting it
with those of the words that have bits in the same blocks; the bits that are left
are the places of the longer phrase, and their number is its count in the shard.
That goes depth first, some first words at a time, so memory follows the batch.
Spark adds the counts of the shards.

Shards know what is frequent in the whole corpus before they count: the words of a
shard come back with an id if they are common enough in all, and phrases of frequent
words are extended only where both their beginnings and their ends may be frequent,
by a bit table of the shorter frequent phrases whose size is bounded; a bit that is
set wrongly costs a row more and changes no result.

Defined results: a null or empty text has no words; a null lang is its own language
UNKNOWN; repeated rows count as often as they occur; a language without candidates
has no rows; an empty table gives none. Long texts are cut between pieces.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise

UNKNOWN = "und"
MOST_WORDS, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Positions of a block of a bitmap; entries of first words that are extended together.
BLOCK, BATCH = 16, 1 << 16
#: Bits of the table of frequent phrases: 16 for each phrase, within these bounds (8 KB to 64 MB).
FEWEST_BITS, MOST_BITS = 16, 29
#: Groups of a language among which its first rows are found before they meet.
SALTS = 32

PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"]] = PIECE[10:14] = True
GAP = PIECE.copy()
GAP[[9, 32]] = True

SHARD_SCHEMA = "lang string, n bigint, words binary, lengths binary, counts binary, tokens binary"


def _long_texts_cut(buf: np.ndarray, off: np.ndarray, limit: int) -> np.ndarray:
    """off with borders more, where texts over the limit have a piece's end."""
    if not (np.diff(off) > limit).any():
        return off
    ends = np.flatnonzero(PIECE[buf])
    more = [ends[np.searchsorted(ends, np.arange(a + limit, b, limit)).clip(max=len(ends) - 1)] for a, b in zip(off[:-1], off[1:], strict=True) if b - a > limit and len(ends)]
    cuts = np.concatenate(more) if more else np.zeros(0, np.int64)
    return np.unique(np.concatenate([off, cuts]))


def shard_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words, their lengths, their counts, word numbers by position with -1 between pieces)."""
    low = K.LOWER[buf]
    start, end = K.runs(~GAP[low], off)
    hashes = K.span_hash(K.prefix_hash(low), start, end) + (end - start).astype(np.uint64)
    _, where, number, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(PIECE[low])])
    document = np.searchsorted(off, start, side="right")
    apart = (ends[start[1:]] > ends[end[:-1]]) | (document[1:] > document[:-1])
    at = np.arange(len(start))
    at[1:] += np.cumsum(apart)
    tokens = np.full(int(at[-1]) + 1 if len(at) else 0, -1, np.int32)
    tokens[at] = number
    sizes = (end - start)[where]
    return low[K.spread(start[where], sizes)], sizes.astype(np.int32), counts.astype(np.int32), tokens


def _shard_batches(batches):
    for batch in batches:
        langs = pc.dictionary_encode(batch.column(0).cast(pa.string()))
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            buf, off = K.text_bytes(batch.column(1).take(pa.array(np.flatnonzero(codes == k))))
            off = _long_texts_cut(buf, off, K.SLICE_BYTES)
            for i, j in K.slices(off):
                words, sizes, counts, tokens = shard_of(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if len(counts):
                    row = [lang, int(counts.sum()), *map(K.packed, (words, sizes, counts, tokens))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["lang", "n", "words", "lengths", "counts", "tokens"])


def make_shards(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(shard, lang, n, words, lengths, counts, tokens), stored: all words of all texts."""
    rows = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.col(text_col).cast("string"))
    shards = rows.mapInArrow(_shard_batches, SHARD_SCHEMA)
    return materialise(shards.select(F.monotonically_increasing_id().alias("shard"), "*"))


def _word_batches(batches):
    for batch in batches:
        for shard, lang, words, lengths, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes, n = K.unpacked(lengths, np.int32), K.unpacked(counts, np.int32)
            borders = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            strings = pa.StringArray.from_buffers(len(n), pa.py_buffer(borders.tobytes()), pa.py_buffer(K.unpacked(words, np.uint8).tobytes()))
            same = lambda x, t: pa.repeat(pa.scalar(x, t), len(n))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([same(shard, pa.int64()), same(lang, pa.string()), strings, pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["shard", "lang", "word", "at", "n"])


def shard_words(shards: DataFrame) -> DataFrame:
    """(shard, lang, word, at, n): the distinct words of every shard, their numbers there and their counts."""
    return shards.select("shard", "lang", "words", "lengths", "counts").mapInArrow(_word_batches, "shard bigint, lang string, word string, at int, n bigint")


def frequent_words(words: DataFrame, least: int) -> DataFrame:
    """(w1, lang, word, a), stored: words with a count of least in their language; w1 is the word's id, another in each language."""
    sums = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return materialise(sums.select(F.monotonically_increasing_id().alias("w1"), "lang", "word", "a"))


# bitmaps: rows (owner, block, bits) sorted by owner and block


def word_bitmaps(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bitmaps of the words (numbers from 0; -1 has none) by their positions."""
    at = np.flatnonzero(tokens >= 0)
    at = at[np.argsort(tokens[at], kind="stable")]
    owner, block = tokens[at], at // BLOCK
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]))[: len(at)]
    bits = np.bitwise_or.reduceat(np.left_shift(1, at % BLOCK).astype(np.uint16), new) if len(at) else np.zeros(0, np.uint16)
    return owner[new], block[new], bits


def shifted(owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every bit one position on; what leaves a block enters the next. Rows aren't sorted and may share a block."""
    inside = (bits << np.uint16(1)).astype(np.uint16)
    over = bits >> np.uint16(BLOCK - 1)
    stays, moves = np.flatnonzero(inside), np.flatnonzero(over)
    return np.concatenate([owner[stays], owner[moves]]), np.concatenate([block[stays], block[moves] + 1]), np.concatenate([inside[stays], over[moves]])


class Extender:
    """Extends the bitmaps of phrases by each word that follows them."""

    def __init__(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int):
        order = np.argsort(words[1], kind="stable")
        self.word, self.bits = words[0][order], words[2][order]
        self.first = np.searchsorted(words[1][order], np.arange(blocks + 2))

    def __call__(self, owner, block, bits):
        """(owner, word, block, bits) with bits, sorted by owner, word and block."""
        owner, block, bits = shifted(owner, block, bits)
        many = self.first[block + 1] - self.first[block]
        other = K.spread(self.first[block], many)
        both = np.repeat(bits, many) & self.bits[other]
        left = np.flatnonzero(both)
        owner, block, word = np.repeat(owner, many)[left], np.repeat(block, many)[left], self.word[other[left]]
        order = np.lexsort((block, word, owner))
        return owner[order], word[order], block[order], both[left][order]


def _slots(ids: list[np.ndarray], bits: int) -> np.ndarray:
    """The places of phrases in a table of 2**bits bits."""
    h = np.zeros(len(ids[0]), np.uint64)
    for x in ids:
        h = K.mix(h * np.uint64(K.MULTIPLIER) + x.astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _told(table: tuple[int, np.ndarray], ids: list[np.ndarray]) -> np.ndarray:
    slots = _slots(ids, table[0])
    return (table[1][slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def phrase_counts(tokens: np.ndarray, ids: np.ndarray, length: int, tables: dict[int, tuple[int, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """(ids of the words, one array for each place, and counts) of the phrases of a length in one shard.

    ids: those of the words by their numbers in tokens. tables: for shorter lengths
    the bits of what may be frequent.
    """
    bitmaps = word_bitmaps(tokens)
    extend = Extender(bitmaps, len(tokens) // BLOCK + 1)
    out, counts = [], []
    done = 0
    while done < len(bitmaps[0]):
        # whole words, about BATCH entries
        stop = int(np.searchsorted(bitmaps[0], bitmaps[0][min(done + BATCH, len(bitmaps[0])) - 1], side="right"))
        phrases = [np.unique(bitmaps[0][done:stop])]
        owner, block, bits = np.searchsorted(phrases[0], bitmaps[0][done:stop]), bitmaps[1][done:stop], bitmaps[2][done:stop]
        done = stop
        for size in range(2, length + 1):
            owner, word, block, bits = extend(owner, block, bits)
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])]))[: len(owner)]
            phrases = [p[owner[new]] for p in phrases] + [word[new]]
            owner = np.cumsum(np.bincount(new, minlength=len(owner))) - 1
            if size == length:
                out.append([ids[p] for p in phrases])
                counts.append(np.add.reduceat(np.bitwise_count(bits).astype(np.int64), new) if len(new) else np.zeros(0, np.int64))
            keep = np.ones(len(new), bool)
            for k, table in tables.items():  # every part of a known length
                if k <= size:
                    keep &= _told(table, [ids[p] for p in phrases[-k:]])
            if size == length:
                out[-1], counts[-1] = [p[keep] for p in out[-1]], counts[-1][keep]
            else:
                stays = keep[owner]
                owner, block, bits = (np.cumsum(keep) - 1)[owner[stays]], block[stays], bits[stays]
                phrases = [p[keep] for p in phrases]
    if not out:
        return [np.zeros(0, np.int64)] * length, np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*out, strict=True)], np.concatenate(counts)


def _phrase_batches(length: int, shared):
    names = [*(f"w{k + 1}" for k in range(length)), "n"]

    def run(batches):
        tables = {k: (bits, np.frombuffer(raw, np.uint8)) for k, (bits, raw) in shared.value.items()}
        for batch in batches:
            for r in range(len(batch)):
                known = batch.column(1)[r].values
                at, ids = known.field(0).to_numpy(), known.field(1).to_numpy()
                tokens = K.unpacked(batch.column(0)[r].as_py(), np.int32)
                number = np.full(int(max(tokens.max(), at.max())) + 2, -1, np.int32)
                number[at] = np.arange(len(at))
                words, counts = phrase_counts(number[tokens], ids, length, tables)
                if len(counts):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*words, counts)], names=names)

    return run, ", ".join(f"{c} bigint" for c in names)


def _table_bits(slot_bits: int):
    def run(table: pa.Table) -> pa.Table:
        slots = table["slot"].to_numpy()
        own = np.zeros(1 << FEWEST_BITS - 3, np.uint8)
        low = slots & (1 << FEWEST_BITS) - 1
        np.bitwise_or.at(own, low >> 3, np.left_shift(1, low & 7).astype(np.uint8))
        return pa.table({"part": pa.array([int(slots[0]) >> FEWEST_BITS], pa.int32()), "bits": pa.array([own.tobytes()], pa.binary())})

    return run


def frequent_table(phrases: DataFrame, length: int) -> tuple[int, bytes]:
    """(bits, table): the bits of all phrases (w1, ...), at most 2**MOST_BITS of them whatever their number."""
    bits = min(max(FEWEST_BITS, (16 * phrases.count()).bit_length()), MOST_BITS)

    def slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots([c.to_numpy(zero_copy_only=False) for c in batch.columns], bits), pa.int64())], names=["slot"])

    # distinct first, so a part has at most 2**FEWEST_BITS rows
    distinct = phrases.select(*(f"w{k + 1}" for k in range(length))).mapInArrow(slots, "slot bigint").distinct()
    parts = distinct.groupBy(F.shiftright("slot", FEWEST_BITS).alias("part")).applyInArrow(_table_bits(bits), "part int, bits binary")
    out = bytearray(1 << bits - 3)
    size = 1 << FEWEST_BITS - 3
    for row in parts.toLocalIterator():
        out[row["part"] * size : (row["part"] + 1) * size] = row["bits"]
    return bits, bytes(out)


def count_phrases(documents: DataFrame, most: int = MOST_WORDS, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[dict[int, DataFrame], DataFrame]:
    """(phrases, totals): for each length to most the phrases (w1, ..., a) with a count of least, words with lang and word; and (lang, n)."""
    shards = make_shards(documents, text_col, lang_col)
    words = shard_words(shards)
    phrases = {1: frequent_words(words, least)}
    known = words.select("shard", "lang", "word", "at").join(phrases[1].select("lang", "word", "w1"), ["lang", "word"])
    known = known.groupBy("shard").agg(F.collect_list(F.struct("at", F.col("w1").alias("id"))).alias("known"))
    # what follows reads it once for each length
    numbered = shards.select("shard", "tokens").join(known, "shard").select("tokens", "known")
    numbered = materialise(numbered) if most > 2 else numbered
    context, tables = documents.sparkSession.sparkContext, {}
    for length in range(2, most + 1):
        run, schema = _phrase_batches(length, context.broadcast(dict(tables)))
        ids = [f"w{k + 1}" for k in range(length)]
        sums = numbered.mapInArrow(run, schema).groupBy(*ids).agg(F.sum("n").alias("a"))
        phrases[length] = materialise(sums.where(F.col("a") >= least))
        if length < most:
            tables[length] = frequent_table(phrases[length], length)
    return phrases, shards.groupBy("lang").agg(F.sum("n").alias("n"))


def _named(phrases: DataFrame, length: int, first: int, count: str) -> DataFrame:
    """phrases with ids named as those from place first on of a longer phrase, and their counts as count."""
    return phrases.select(*(F.col(f"w{k + 1}").alias(f"w{first + k}") for k in range(length)), F.col("a").alias(count))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) with as many digits as that needs."""
    wide = lambda c: c.cast("decimal(18,0)")
    over, under = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)
    return F.call_function("div", over, under)


def scored(phrases: dict[int, DataFrame], length: int) -> DataFrame:
    """(w1, ..., a, l, r, score): phrases of a length with their lowest-scoring cut."""
    rows, options = phrases[length], []
    for k in range(1, length):
        left, right = _named(phrases[k], k, 1, f"l{k}"), _named(phrases[length - k], length - k, k + 1, f"r{k}")
        rows = rows.join(left, [f"w{i + 1}" for i in range(k)]).join(right, [f"w{i + 1}" for i in range(k, length)])
        options.append(F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = rows.select(*(f"w{i + 1}" for i in range(length)), "a", F.array_min(F.array(*options)).alias("best"))
    return best.select(*(f"w{i + 1}" for i in range(length)), "a", "best.l", "best.r", "best.score")


def uncovered(rows: DataFrame, phrases: dict[int, DataFrame], length: int, covered: int) -> DataFrame:
    """rows without those that a longer phrase holds in covered percent of their places or more."""
    ids = [f"w{i + 1}" for i in range(length)]
    longer = [phrases[m].select(*(F.col(f"w{at + i}").alias(f"w{i + 1}") for i in range(length)), F.col("a").alias("around")) for m in phrases if m > length for at in range(1, m - length + 2)]
    if not longer:
        return rows
    most = reduce(DataFrame.unionByName, longer).groupBy(*ids).agg(F.max("around").alias("around"))
    return rows.join(most, ids, "left").where(F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True))).drop("around")


def collocations(documents: DataFrame, most: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top phrases of two to most words of each language.

    a: count of the phrase; l and r: those of its parts at the cut with the least
    score, floor(1000000 a a / (l r)); n: all words of the language. Phrases with a
    count under least are no candidates; a candidate that stands in a longer one in
    covered percent of its places or more is left out.
    """
    phrases, totals = count_phrases(documents, most, least, text_col, lang_col)
    found = []
    for length in range(2, most + 1):
        rows = uncovered(scored(phrases, length), phrases, length, covered)
        for k in range(1, length + 1):
            own = phrases[1].select(F.col("w1").alias(f"w{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 1 else []))
            rows = rows.join(own, f"w{k}")
        found.append(rows.select("lang", F.concat_ws(" ", *(f"word{k}" for k in range(1, length + 1))).alias("phrase"), "a", "l", "r", "score"))
    rows = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, covered: int = COVERED, top: int = TOP) -> str:
    """The same for phrases of two and three words in SQL."""
    part = lambda name, cols: f"{name} AS (SELECT lang, {cols}, count(*) AS a FROM places WHERE {' AND '.join(c + ' IS NOT NULL' for c in cols.split(', '))} GROUP BY lang, {cols}{' HAVING count(*) >= ' + str(least) if ',' in cols else ''})"
    value = lambda a, x, y: f"((1000000::HUGEINT * {a}::HUGEINT * {a}::HUGEINT) // ({x}::HUGEINT * {y}::HUGEINT))::BIGINT"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH pieces AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM split, unnest(range(1, len(w) + 1)) AS u(i)),
{part('f1', 'w1')}, {part('f2', 'w1, w2')}, {part('f3', 'w1, w2, w3')},
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f1 GROUP BY lang),
around AS (SELECT lang, w1, w2, max(a) AS around FROM (SELECT lang, w1, w2, a FROM f3 UNION ALL SELECT lang, w2, w3, a FROM f3) GROUP BY ALL),
two AS (SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.a, x.a AS l, y.a AS r, {value('p.a', 'x.a', 'y.a')} AS score
        FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
        LEFT JOIN around o ON o.lang = p.lang AND o.w1 = p.w1 AND o.w2 = p.w2 WHERE o.around IS NULL OR 100 * o.around < {covered} * p.a),
cuts AS (SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3 AS phrase, p.a, x.a AS l1, y.a AS r1, z.a AS l2, q.a AS r2, {value('p.a', 'x.a', 'y.a')} AS s1, {value('p.a', 'z.a', 'q.a')} AS s2
         FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
         JOIN f2 z ON z.lang = p.lang AND z.w1 = p.w1 AND z.w2 = p.w2 JOIN f1 q ON q.lang = p.lang AND q.w1 = p.w3),
found AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""
