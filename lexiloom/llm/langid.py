"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The
vector of a letter trigram is the product of its letters' vectors, the first
permuted twice and the second once. A text's profile is the sum over its trigrams;
a language's prototype is the sum over the texts labelled with it. A text gets the
language whose prototype has the largest cosine with its profile, both taken
relative to the mean of all prototypes.

Training gathers one sum per language and dimension, so what is shuffled and sent
to the driver is bounded by languages x DIMENSIONS whatever the corpus. A text of
more than a slice's length is read in pieces, and n-gram vectors are bound VECTORS at
a time, so memory follows neither the length of a text nor its alphabet.

Defined results: a text that is null or has no letter is 'und' with score 0; so is
every text where nothing was learned; ties go to the first language by name; a row
without a doc_id counts as not held out but is not learned from.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import kernels as K

DIMENSIONS = 1024
UNKNOWN = "und"
#: N-gram vectors that are held at once.
VECTORS = 8_192


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is none."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@lru_cache(maxsize=20_000)
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def _trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (three letter columns, 0 is a word's edge), the trigram of each place, its document, and the documents' letter counts."""
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    raw = buf.tobytes()
    text = raw.decode("utf-8", "replace")
    if len(text) != chars[-1]:  # invalid UTF-8: count what each document decodes to
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
        text, chars = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = _letter_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    n = np.diff(chars)
    doc = np.repeat(np.arange(len(n)), n + 1)
    flat = np.zeros(len(codes) + len(n), np.uint32)
    flat[K.spread(chars[:-1] + np.arange(len(n)) + 1, n)] = codes
    letters = np.bincount(doc[flat != 0], minlength=len(n))
    keep = (flat != 0) | np.append(True, flat[:-1] != 0)
    flat, doc = np.append(flat[keep], np.uint32(0)), doc[keep]
    middle = np.flatnonzero(flat[1:-1] != 0) + 1 if len(flat) > 2 else np.zeros(0, np.int64)
    alphabet, dense = np.unique(flat, return_inverse=True)
    size = len(alphabet)
    code = (dense[middle - 1] * size + dense[middle]) * size + dense[middle + 1] if len(middle) else np.zeros(0, np.int64)
    if size**3 <= 1 << 22:
        seen = np.bincount(code, minlength=1) > 0
        distinct = np.flatnonzero(seen)
        of = (np.cumsum(seen) - 1)[code]
    else:
        distinct, of = np.unique(code, return_inverse=True)
    three = np.stack([alphabet[distinct // (size * size)], alphabet[distinct // size % size], alphabet[distinct % size]], axis=1)
    return three, of, doc[middle], letters


def _vectors(three: np.ndarray) -> np.ndarray:
    codes, back = np.unique(three, return_inverse=True)
    base = np.stack([_letter(int(c)) for c in codes]) if len(codes) else np.zeros((0, DIMENSIONS), np.int8)
    back = back.reshape(three.shape)
    return (np.roll(base, 2, axis=1)[back[:, 0]] * np.roll(base, 1, axis=1)[back[:, 1]] * base[back[:, 2]]).astype(np.float32)


def _pieces(buf: np.ndarray, off: np.ndarray):
    """(first, last + 1, trigrams..., end) of slices of documents; a longer document comes in pieces, the last of them with end True."""
    for i, j in K.slices(off):
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * K.SLICE_BYTES:
            yield i, j, *_trigrams(buf[a:b], off[i : j + 1] - a), True
            continue
        cuts = [a]
        while cuts[-1] < b:
            at = min(cuts[-1] + K.SLICE_BYTES, b)
            while at < b and buf[at] & 0xC0 == 0x80:
                at += 1
            cuts.append(at)
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            # a character of what stands before and behind tells the edges' trigrams, and is then left out
            low, high = x, y
            while low > a and (low == x or buf[low] & 0xC0 == 0x80):
                low -= 1
            while high < b and (high == y or buf[high] & 0xC0 == 0x80):
                high += 1
            three, of, doc, letters = _trigrams(buf[low:high], np.array([0, high - low]))
            before, behind = (_letter_count(buf[p:q]) for p, q in ((low, x), (y, high)))
            own = slice(before, len(of) - behind)
            yield i, j, three, of[own], doc[own], letters - before - behind, y == b


def _letter_count(buf: np.ndarray) -> int:
    return int(np.count_nonzero(_letter_table()[[ord(c) for c in buf.tobytes().decode("utf-8", "replace")]])) if len(buf) else 0


def _bundle(three: np.ndarray, of: np.ndarray, vectors: np.ndarray | None) -> np.ndarray:
    """The sum of the vectors of the trigrams in of; vectors has those of all three, if they are few."""
    counts = np.bincount(of, minlength=len(three)).astype(np.float32)
    on = np.flatnonzero(counts)
    if vectors is not None:
        return (counts[on] @ vectors[on]).astype(np.float64)
    total = np.zeros(DIMENSIONS)
    for k in range(0, len(on), VECTORS):
        part = on[k : k + VECTORS]
        total += counts[part] @ _vectors(three[part])
    return total


def _few(three: np.ndarray) -> np.ndarray | None:
    return _vectors(three) if len(three) <= 2 * VECTORS else None


def _train_batches(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        buf, off = K.text_bytes(batch.column(1))
        for i, j, three, of, doc, _, _ in _pieces(buf, off):
            if not len(of):
                continue
            own = langs[i:j]
            vectors = _few(three)
            for lang in sorted(set(own)):
                sums[lang] = sums.get(lang, 0.0) + _bundle(three, of[(own == lang)[doc]], vectors)
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], names=["lang", "dim", "total"])


def learn_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their unit prototypes relative to the mean, and the mean's unit vector."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_train_batches, "lang string, dim int, total double").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    table = sums.toPandas()  # languages x DIMENSIONS rows
    langs = sorted(table["lang"].unique())
    proto = np.zeros((len(langs), DIMENSIONS))
    if len(langs):
        proto[np.searchsorted(langs, table["lang"].to_numpy(str)), table["dim"]] = table["total"]
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    proto = unit(proto)
    mean = proto.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    return langs, unit(proto - mean).astype(np.float32), mean.astype(np.float32)


def _predict_batches(model, keep_text):
    def run(batches):
        langs, proto, mean = model.value
        for batch in batches:
            n = batch.num_rows
            best, score, letters_of = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
            buf, off = K.text_bytes(batch.column(batch.num_columns - 1))
            long = np.zeros(DIMENSIONS)
            for i, j, three, of, doc, letters, end in _pieces(buf, off) if langs else ():
                vectors = _few(three)
                letters_of[i:j] += letters
                edges = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    if edges[d] < edges[d + 1]:
                        profile = _bundle(three, of[edges[d] : edges[d + 1]], vectors)
                        if j - i == 1:
                            profile = long = long + profile
                    elif j - i == 1:
                        profile = long
                    if not end or not letters_of[i + d]:
                        continue
                    profile = profile / max(float(np.linalg.norm(profile)), 1e-12) - mean
                    cosine = proto @ (profile / max(float(np.linalg.norm(profile)), 1e-12))
                    k = int(cosine.argmax())
                    best[i + d], score[i + d] = langs[k], min(1.0, max(0.0, (1 + float(cosine[k])) / 2))
                if end:
                    long = np.zeros(DIMENSIONS)
            given = batch.columns if keep_text else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*given, pa.array(best, pa.string()), pa.array(score), pa.array(letters_of, pa.int64())], names=[*batch.schema.names[: len(given)], "lang_pred", "score", "letters"])

    return run


def held_out(id_col: str, folds: int, fold: int):
    """Whether the row belongs to the fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict_languages(rows: DataFrame, labelled: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The other columns of rows with lang_pred, score (0 to 1, from the cosine) and the number of letters; keep_text: the text too.

    Columns of rows that have one of these names are replaced.
    """
    model = rows.sparkSession.sparkContext.broadcast(learn_prototypes(labelled))
    others = [f for f in rows.schema.fields if f.name not in ("lang_pred", "score", "letters", text_col)]
    given = rows.select(*(F.col(f"`{f.name}`") for f in others), F.col(text_col).cast("string"))
    own = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("letters", LongType())]
    schema = StructType([*others, *[StructField(text_col, StringType())] * keep_text, *own])
    return given.mapInArrow(_predict_batches(model, keep_text), schema)


def identify(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the folds that are not held out."""
    fold = held_out("doc_id", 3, 1)
    labelled = documents.where(F.col("doc_id").isNotNull() & ~fold).select("text", "lang")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold.alias("held_out"), "text")
    return predict_languages(rows, labelled).select("doc_id", "held_out", "lang_pred", "score", "letters")
