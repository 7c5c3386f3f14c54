"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to lists around centroids fitted on a bounded sample; the number
of lists grows with the square root of the rows. Within a list vectors are turned by
one random rotation and kept in blocks of columns. A query scans the blocks one after
the other: after m of D rotated dimensions the partial distance, scaled by D/m,
estimates the whole, and a test of size SIZE abandons candidates that are unlikely to
come under the bound of the best found so far. Survivors of all blocks are scored
with the inner product of the original vectors in double precision.

Lists are probed in two passes. The first takes each query's likeliest FIRST lists
and gives a bound. The second takes so many of the others that those left out hold
MISSED of the neighbours at most, by the means and variances of the lists. So vectors
in clusters cost a few lists a query; vectors without any structure, whose neighbours
are nearly as far as all others, cost most lists, and what is saved is dimensions.

A list with more than BLOCK_ROWS rows is dealt in blocks of rows, and the queries
on a list in blocks of QUERY_ROWS, so a list around one very common vector makes
no large task.

Defined results: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components take no part, nor do rows without a
vec_id; ties go to the smaller vec_id; rows that repeat a vec_id are one candidate
with their best score, and ask with the least of their vectors; with fewer
candidates than asked for all are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

TOP = 20
#: Lists are LISTS x the root of the rows, fitted on SAMPLE_PER_LIST vectors each (SAMPLE_ROWS at least), so at most 262,144 vectors are sampled.
LISTS, MOST_LISTS, SAMPLE_PER_LIST, SAMPLE_ROWS = 0.5, 4_096, 64, 20_000
#: Lists of the first pass, and the share of neighbours that the lists left out may hold by estimate.
FIRST, MISSED = 4, 0.03
COLUMN_BLOCK = 8
#: How many standard deviations a scaled partial distance may lie over the bound.
SIZE = 2.6
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
#: Distances or estimates held at a time where vectors are compared with lists: 8 MB of each kind.
CELLS = 1 << 20
#: Candidates and queries in one step of a task, and the share of pairs under which they are computed one by one.
CHUNK_ROWS, QUERY_CHUNK, SPARSE = 2_048, 256, 0.05
SEED = 7


def valid_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    vec = F.col("vec")
    given = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(F.col("vec_id").isNotNull() & vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """k-means on the sample; an empty list takes over the farthest vector."""
    rng = np.random.default_rng(SEED)
    centers = sample[rng.choice(len(sample), lists, replace=False)].copy()
    step = max(1, CELLS // lists)
    for _ in range(rounds):
        near, apart = np.zeros(len(sample), np.int64), np.zeros(len(sample))
        for a in range(0, len(sample), step):
            distance = (centers**2).sum(1)[None, :] - 2 * sample[a : a + step] @ centers.T
            near[a : a + step], apart[a : a + step] = distance.argmin(1), distance.min(1)
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        # the farthest vector, for lists without any
        centers = np.repeat(sample[int((apart + (sample**2).sum(1)).argmax())][None], lists, axis=0)
        centers[held] = np.add.reduceat(sample[order], first, axis=0) / np.diff(np.append(first, len(sample)))[:, None]
    return centers


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def _assign(model):
    """The nearest list of each row."""

    def run(batches):
        centers = model.value
        step = max(1, CELLS // len(centers))
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, max(1, len(whole)), step)):
            vecs = batch.column(1)
            matrix = np.asarray(vecs.flatten()).reshape(len(vecs), -1) if len(vecs) else np.zeros((0, centers.shape[1]))
            gap = (centers**2).sum(1)[None, :] - 2 * matrix @ centers.T
            yield pa.RecordBatch.from_arrays([batch.column(0), vecs, pa.array(gap.argmin(1) if len(matrix) else [], pa.int32())], names=["vec_id", "vec", "list"])

    return run


def _moments(dimensions):
    """Rows, sums and sums of squares of each list in a task."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = np.asarray(batch.column(1))
            matrix = np.asarray(batch.column(0).flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, dimensions))
            for k in np.unique(lists).tolist():
                own = matrix[lists == k]
                sums[k] = sums.get(k, 0.0) + np.concatenate([[len(own)], own.sum(0), (own**2).sum(0)])
        columns = [np.repeat(list(sums), 2 * dimensions + 1), np.tile(np.arange(2 * dimensions + 1), len(sums)), np.concatenate(list(sums.values())) if sums else np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.float64), strict=True)], names=["list", "k", "total"])

    return run


def list_moments(indexed: DataFrame, lists: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and variances of every list; lists x (2 x dimensions + 1) numbers come to the driver."""
    parts = indexed.select("vec", "list").mapInArrow(_moments(dimensions), "list int, k int, total double")
    table = np.zeros((lists, 2 * dimensions + 1))
    for r in parts.groupBy("list", "k").agg(F.sum("total").alias("total")).collect():
        table[r["list"], r["k"]] = r["total"]
    n = np.maximum(table[:, :1], 1)
    mean = table[:, 1 : dimensions + 1] / n
    return table[:, 0], mean, np.maximum(table[:, dimensions + 1 :] / n - mean**2, 0)


def _above(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above x, within 1e-7."""
    a = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * a)
    # The coefficients of a Chebyshev fit of erfc.
    fit = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    half = 0.5 * t * np.exp(np.minimum(-a * a + fit, 0))
    return np.where(x >= 0, half, 1 - half)


def expected_hits(queries: np.ndarray, moments, bound: np.ndarray, top: int) -> np.ndarray:
    """How many rows of each list are likely to score over the bound of each query, or over what top rows in all are likely to reach if that is more."""
    n, mean, variance = moments
    at = queries @ mean.T
    spread = np.sqrt(np.maximum(queries**2 @ variance.T, 1e-18))
    hits = lambda x: n * _above((x[:, None] - at) / spread)
    low, high = (at - 6 * spread).min(1), (at + 6 * spread).max(1)
    for _ in range(20):
        middle = (low + high) / 2
        many = hits(middle).sum(1) > top
        low, high = np.where(many, middle, low), np.where(many, high, middle)
    return np.where((bound == -np.inf)[:, None], n, hits(np.maximum(low, bound)))


def _choose(model, top, first, missed):
    """first: the lists of the first pass; else those that join them in the second."""

    def run(batches):
        moments = model.value
        lists = len(np.asarray(moments[0]))
        step = max(1, CELLS // lists)
        for batch in (whole.slice(a, step) for whole in batches for a in range(0, len(whole), step)):
            vecs = batch.column(1)
            queries = np.asarray(vecs.flatten()).reshape(len(vecs), -1)
            bound = np.asarray(batch.column(2)).astype(float)
            # the first lists are those of no bound, so the second pass can tell them
            likely = expected_hits(queries, moments, np.full(len(queries), -1e300), top)
            order = np.argsort(-likely, axis=1, kind="stable")
            if missed is None:
                chosen = [x[:first].astype(np.int32) for x in order]
            else:
                hits = expected_hits(queries, moments, bound, top)
                np.put_along_axis(hits, order[:, :first], 0, axis=1)
                order = np.argsort(-hits, axis=1, kind="stable")
                sorted_ = np.take_along_axis(hits, order, axis=1)
                left = sorted_[:, ::-1].cumsum(1)[:, ::-1]
                chosen = [o[: int((x > missed * top).sum())].astype(np.int32) for o, x in zip(order, left, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), vecs, batch.column(2), pa.array(chosen, pa.list_(pa.int32()))], names=["vec_id", "vec", "bound", "list"])

    return run


def _keep_best(best: tuple[np.ndarray, np.ndarray, np.ndarray], query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int):
    """The first top of each query among the best so far and new candidates; an id counts once, with its best score."""
    query, ids, scores = (np.concatenate(x) for x in zip(best, (query, ids, scores), strict=True))
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    once = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[: len(query)]
    query, ids, scores = query[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < top], ids[rank < top], scores[rank < top]


def scan(asked: np.ndarray, queries: np.ndarray, bounds: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, top: int):
    """(query row, id, score) of the best candidates of every query whose scores reach its bound, and the number of components that were compared.

    Candidates come in chunks. Partial distances grow by one block of columns after
    the other; after each block the pairs that fail the test are abandoned, and once
    few are left only they are computed.
    """
    dimensions = vectors.shape[1]
    left, right = queries @ turn, vectors @ turn
    cuts = [slice(m, min(m + COLUMN_BLOCK, dimensions)) for m in range(0, dimensions, COLUMN_BLOCK)]
    left_blocks = [np.ascontiguousarray(left[:, c]) for c in cuts]
    lengths, norms = (left**2).sum(1), (right**2).sum(1)
    best, compared = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0
    at, step = 0, 4 * top
    while at < len(ids):
        rows = slice(at, min(at + step, len(ids)))
        at, step = rows.stop, CHUNK_ROWS
        allowed = ids[rows][None, :] != asked[:, None]
        last = bounds.copy()
        if len(best[0]):
            full = np.bincount(best[0], minlength=len(asked)) >= top
            np.minimum.at(worst := np.full(len(asked), np.inf), best[0], best[2])
            last[full] = np.maximum(last[full], worst[full])
        # nearer than this means a larger inner product than the last one so far
        bound = lengths[:, None] + norms[rows][None, :] - 2 * last[:, None]
        partial, pairs = np.zeros(bound.shape), None
        for k, cut in enumerate(cuts):
            block, m = right[rows, cut], cut.stop
            # the share of a random direction's length in m of all dimensions has this variance
            slack = m / dimensions * (1 + SIZE * math.sqrt(2 * (dimensions - m) / (m * (dimensions + 2)))) + 1e-9
            if pairs is None:
                partial += (left_blocks[k] ** 2).sum(1)[:, None] + (block**2).sum(1)[None, :] - 2 * left_blocks[k] @ block.T
                compared += partial.size * (cut.stop - cut.start)
                live = (partial <= bound * slack + 1e-9) & allowed
                if m == dimensions or live.mean() < SPARSE:
                    pairs = np.nonzero(live)
                    partial, bound = partial[pairs], bound[pairs]
            else:
                partial = partial + ((left_blocks[k][pairs[0]] - block[pairs[1]]) ** 2).sum(1)
                compared += len(partial) * (cut.stop - cut.start)
                good = partial <= bound * slack + 1e-9
                pairs, partial, bound = (pairs[0][good], pairs[1][good]), partial[good], bound[good]
        near = pairs[1] + rows.start
        score = (queries[pairs[0]] * vectors[near]).sum(1)
        over = score >= last[pairs[0]] - 1e-12
        best = _keep_best(best, pairs[0][over], ids[near[over]], score[over], top)
    return best, compared


def _search_group(top, turn):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and queries.num_rows:
            ids = np.asarray(index["vec_id"].combine_chunks())
            vectors = np.asarray(index["vec"].combine_chunks().flatten()).reshape(len(ids), -1)
            asked, bounds = np.asarray(queries["vec_id"].combine_chunks()), np.asarray(queries["bound"].combine_chunks())
            vecs = np.asarray(queries["vec"].combine_chunks().flatten()).reshape(len(asked), -1)
            for q in range(0, len(asked), QUERY_CHUNK):
                part = slice(q, q + QUERY_CHUNK)
                (own, found, scores), _ = scan(asked[part], vecs[part], bounds[part], ids, vectors, turn, top)
                out.append((asked[part][own], found, scores))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64), strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _probe(indexed: DataFrame, queries: DataFrame, sizes: np.ndarray, top: int, turn: np.ndarray) -> DataFrame:
    """The best of every (list, block of rows, block of queries)."""
    spark = indexed.sparkSession
    asked = {r[0]: r[1] for r in queries.groupBy("list").count().collect()}  # one row per list
    cuts = [(k, max(1, -(-int(n) // BLOCK_ROWS)), max(1, -(-asked.get(k, 0) // QUERY_ROWS))) for k, n in enumerate(sizes)]
    plan = F.broadcast(spark.createDataFrame(cuts, "list int, n_rows int, n_queries int"))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = indexed.join(plan, "list").withColumn("row_block", spread("n_rows", 1)).withColumn("query_block", every("n_queries"))
    right = queries.join(plan, "list").withColumn("query_block", spread("n_queries", 2)).withColumn("row_block", every("n_rows"))
    keys = ["list", "row_block", "query_block"]
    grouped = left.select(*keys, "vec_id", "vec").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vec", "bound").groupBy(*keys))
    return grouped.applyInArrow(_search_group(top, turn), "query_id bigint, vec_id bigint, score double")


def _best(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(rows: DataFrame, is_query, top: int = TOP, missed: float = MISSED) -> DataFrame:
    """For each row where is_query holds (a Column over vec_id) its nearest other rows: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    valid = valid_vectors(rows)
    lists = min(MOST_LISTS, max(1, int(LISTS * math.sqrt(valid.count()))))
    bounded = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists)).select("vec")
    sample = bounded.toArrow()["vec"].combine_chunks()  # of bounded size, fitted on the driver
    lengths = sample.value_lengths().to_numpy(zero_copy_only=False) if len(sample) else np.zeros(0, np.int64)
    dimensions = int(np.bincount(lengths).argmax()) if len(sample) else 1
    matrix = np.asarray(sample.filter(pa.array(lengths == dimensions)).flatten(), float).reshape(-1, dimensions) if len(sample) else np.zeros((0, 1))
    lists = max(1, min(lists, len(matrix)))
    centers = fit_centroids(matrix, lists) if len(matrix) else np.zeros((1, dimensions))
    valid = valid.where(F.size("vec") == dimensions)
    indexed = materialise(valid.mapInArrow(_assign(spark.sparkContext.broadcast(centers)), "vec_id bigint, vec array<double>, list int"))
    moments = list_moments(indexed, lists, dimensions)
    model, turn = spark.sparkContext.broadcast(moments), rotation(dimensions)
    asking = valid.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    schema = "vec_id bigint, vec array<double>, bound double, list array<int>"
    none = F.lit(float("-inf"))
    probing = materialise(asking.withColumn("bound", none).mapInArrow(_choose(model, top, FIRST, None), schema))
    first = materialise(_best(_probe(indexed, probing.withColumn("list", F.explode("list")), moments[0], top, turn), top))
    reached = first.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    again = probing.drop("list", "bound").join(reached, "vec_id", "left").select("vec_id", "vec", F.coalesce("reached", none).alias("bound"))
    again = materialise(again.mapInArrow(_choose(model, top, FIRST, missed), schema).withColumn("list", F.explode("list")))
    more = _probe(indexed, again, moments[0], top, turn)
    return _best(first.drop("rank").unionByName(more), top).select("query_id", "rank", "vec_id", "score")
