"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Tokens are runs of letters and digits and runs of other visible characters, A-Z
lower-cased. Features are tokens, pairs of neighbours, and for a pair of equal
neighbours one shared feature, hashed into 2**BITS weights. A feature's value is
its share of the text's tokens. Weights are fitted on at most TRAIN_ROWS labelled
rows, those with the smallest hashes of their doc_id; scoring is one sparse dot
product per text.

Defined results: null and empty texts are scored with the bias alone; without any
labelled row every score is 0.5; rows with a null label or doc_id aren't learned
from; repeated labels of a document count once, as their maximum; of several texts of
one doc_id the one with the greatest list of (feature, value) is learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .langid import held_out

BITS = 18
TRAIN_ROWS = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
SCALE = 16.0
THRESHOLD = 0.7

VISIBLE = ~K.SPACE
SAME = np.uint64(1)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts in a row, and how many each text has."""
    low = K.LOWER[buf]
    word = K.WORD1[low]
    mark = VISIBLE[low] & ~word
    start = [K.runs(x, off) for x in (word, mark)]
    begin, end = np.concatenate([start[0][0], start[1][0]]), np.concatenate([start[0][1], start[1][1]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    token = K.span_hash(K.prefix_hash(low), begin, end)
    count = np.diff(np.searchsorted(begin, off))
    doc = np.repeat(np.arange(len(count)), count)
    near = doc[1:] == doc[:-1]
    left, right = token[:-1][near], token[1:][near]
    pairs = np.where(left == right, SAME, K.mix(left * np.uint64(3) + right))
    owner = np.concatenate([doc, doc[1:][near]])
    place = np.argsort(owner, kind="stable")
    every = (np.concatenate([token, pairs])[place] & np.uint64((1 << BITS) - 1)).astype(np.int32)
    return every, np.bincount(owner, minlength=len(count)) if len(owner) else np.zeros(len(count), np.int64)


def _feature_batches(batches):
    for batch in batches:
        buf, off = K.text_bytes(batch.column(1))
        for i, j in K.slices(off):
            every, count = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            parts = [np.unique(x, return_counts=True) for x in np.split(every, np.cumsum(count)[:-1])]
            index = pa.array([p[0] for p in parts], pa.list_(pa.int32()))
            value = pa.array([(p[1] / max(1, p[1].sum())).astype(np.float32) for p in parts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in (0, 2)), index, value], names=["order", "label", "at", "value"])


def ftrl(examples, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias) after epochs of FTRL-proximal updates over (features, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        live = np.abs(z[at]) > L1
        return np.where(live, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, value, label in examples:
            at, value = np.append(at, size - 1), np.append(value * SCALE, 1.0)
            w = weights(at)
            gradient = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
            sigma = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / ALPHA
            z[at] += gradient - sigma * w
            n[at] += gradient**2
    return weights(np.arange(size))


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by("order")
    examples = [(np.array(a, np.int64), np.array(v), y) for a, v, y in zip(table["at"].to_pylist(), table["value"].to_pylist(), table["label"].to_pylist(), strict=True)]
    return pa.table({"weights": pa.array([ftrl(examples).astype(np.float32).tobytes()], pa.binary())})


def fit(documents: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights learned from at most rows labelled documents."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label_col).alias("_label"))
    chosen = marks.orderBy(F.xxhash64(F.col("_id").cast("bigint")), "_id").limit(rows)
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    # one row per chosen document, however often its doc_id occurs
    given = texts.join(chosen, "_id").select(F.xxhash64(F.col("_id").cast("bigint")).alias("order"), "_text", F.col("_label").cast("double").alias("label"))
    sparse = given.mapInArrow(_feature_batches, "order bigint, label double, at array<int>, value array<float>")
    sparse = sparse.groupBy("order", "label").agg(F.max(F.struct("at", "value")).alias("one")).select("order", "label", "one.*")
    fitted = sparse.groupBy(F.lit(0).alias("one")).applyInArrow(_fit, "weights binary").collect()  # at most one row
    return np.frombuffer(fitted[0]["weights"], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def _score_batches(model):
    def run(batches):
        weights = model.value
        for batch in batches:
            buf, off = K.text_bytes(batch.column(batch.num_columns - 1))
            scores = [np.zeros(0)]
            for i, j in K.slices(off):
                every, count = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                total = np.concatenate([[0.0], np.cumsum(weights[every], dtype=np.float64)])
                edges = np.concatenate([[0], np.cumsum(count)])
                margin = weights[-1] + SCALE * np.diff(total[edges]) / np.maximum(count, 1)
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores))], names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted; labels of held-out rows are never used."""
    weights = fit(documents, labels.where(~held_out("doc_id", 4, 2)))
    model = documents.sparkSession.sparkContext.broadcast(weights)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string").alias("_text"))
    out = rows.mapInArrow(_score_batches(model), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
