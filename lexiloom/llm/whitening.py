"""Whitening of vectors from an exact scatter, by residues.

Entries become integers, x = floor(64 c) + 1,000,000. Sums of products of x are
larger than a double holds, so every task forms X'X modulo several primes below
2**20: rows go through one matrix product for each prime and 4,096 rows, whose
sums stay below 2**53 and so are exact in doubles. Spark adds the residues of all
tasks, one row for each pair of dimensions, and the Chinese remainder theorem gives
back the exact sums. There are as many primes as the number of rows and the largest
entry ask for, so nothing can wrap at any size. With the sums S the matrix
n X'X - S'S is the scatter of n x - S divided by n: entries are centred before any
rounding happens. Only matrices with a row for each dimension come to the driver,
where eigh in doubles gives the components; the covariance of the whitened rows
is then measured over all of them.

Defined results: vectors that are null, empty or hold a null, an infinite or a
non-finite entry take no part and have no rows; vectors of another length than most
of the others (of equally many the longest) neither; repeated rows count as often as
they occur and each has its rows; components without variance (under 1e-13 of the
trace) are left out, so equal vectors and single ones give no rows, and nor do empty
tables. An entry beyond 2**55 raises, for x or its squares would leave a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Residues are below 2**20 and their products below 2**40: so many rows can be summed exactly.
PRIME_BITS, ROWS = 20, 4096
#: Components under this share of the trace have no variance but that of rounding.
LEAST_SHARE = 1e-13
LARGEST = 2.0**55


def primes_above(bound: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product is over bound."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for k in range(2, 1 << PRIME_BITS // 2):
        if sieve[k]:
            sieve[k * k :: k] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            break
        out.append(p)
        product *= p
    return out


def remaindered(residues: list[int], primes: list[int]) -> int:
    """The number between -M/2 and M/2 with these residues, M the product of the primes."""
    product = math.prod(primes)
    total = sum(r * (product // p) * pow(product // p, -1, p) for r, p in zip(residues, primes, strict=True)) % product
    return total - product if total > product // 2 else total


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows whose vector is neither null nor empty and all whose entries are finite."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(c.between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _whole(column) -> np.ndarray:
    """The x of a list column, one row a vector."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values * SCALE).astype(np.int64).reshape(len(column), -1) + SHIFT


def _residues(primes: list[int]):
    names = ["i", "j", *(f"r{k}" for k in range(len(primes)))]

    def run(batches):
        total = sums = None
        for batch in batches:
            whole = _whole(batch.column(0))
            if total is None:
                d = whole.shape[1]
                total = np.zeros((len(primes), d, d), np.int64)
                sums = np.zeros((len(primes), d), np.int64)
            for a in range(0, len(whole), ROWS):
                for k, p in enumerate(primes):
                    x = (whole[a : a + ROWS] % p).astype(np.float64)
                    total[k] = (total[k] + (x.T @ x).astype(np.int64)) % p
                    sums[k] = (sums[k] + x.sum(0).astype(np.int64)) % p
        if total is not None:
            i, j = np.triu_indices(total.shape[1])
            # the sums are the row -1
            at = [np.append(i, np.full(sums.shape[1], -1)), np.append(j, np.arange(sums.shape[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), *(pa.array(np.append(t[i, j], s), pa.int64()) for t, s in zip(total, sums, strict=True))], names=names)

    return run, "i int, j int, " + ", ".join(f"r{k} bigint" for k in range(len(primes)))


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]], int]:
    """(n, S, T, spread): the number of rows (vec_id, v), the sums of x and of products of x, exact, and the largest difference of two x.

    All vectors of rows have one length. What comes to the driver has one row for
    each pair of dimensions, whatever the number of vectors.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low"), F.max(F.size("v")).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if not n:
        return 0, [], [], 0
    most = max(abs(size["low"]), abs(size["high"])) * SCALE
    if most >= LARGEST:
        raise ValueError(f"an entry of a vector is over {LARGEST / SCALE:g}")
    most = int(most) + SHIFT + 2
    primes = primes_above(2 * n * most * most)
    run, schema = _residues(primes)
    cells = rows.select("v").mapInArrow(run, schema).groupBy("i", "j").agg(*(F.sum(f"r{k}").alias(f"r{k}") for k in range(len(primes))))
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for row in cells.toArrow().to_pylist():
        value = remaindered([row[f"r{k}"] for k in range(len(primes))], primes)
        if row["i"] < 0:
            sums[row["j"]] = value
        else:
            products[row["i"]][row["j"]] = products[row["j"]][row["i"]] = value
    return n, sums, products, math.floor(size["high"] * SCALE) - math.floor(size["low"] * SCALE)


def components(n: int, sums: list[int], products: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvectors as columns, eigenvalues, trace) of the covariance, by falling eigenvalue, without those that have no variance."""
    d = len(sums)
    # the quotient of two whole numbers is rounded once
    covariance = np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], np.float64).reshape(d, d)
    trace = sum(n * products[i][i] - sums[i] * sums[i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > LEAST_SHARE * trace][:most]
    return vectors[:, order], values[order], trace


def _projected(whole: np.ndarray, n: int, sums: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, exact, and the whitened rows."""
    centred = n * whole.astype(sums.dtype) - sums
    return centred, (centred / n).astype(np.float64) @ axes


def _exact(n: int, sums: list[int], spread: int) -> np.ndarray:
    """S as an array of longs where n x, n x - S and the sums of its squares fit into longs, else of Python's numbers."""
    fits = len(sums) * (n * spread) ** 2 < 1 << 62 and max(map(abs, sums)) + n * spread < 1 << 62
    return np.array(sums, np.int64 if fits else object)


def _moments(n, sums, axes):
    """Sums of the whitened rows and of their products, as cells like those of the residues."""

    def run(batches):
        total = None
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                w = _projected(_whole(batch.column(0).slice(a, ROWS)), n, sums, axes)[1]
                own = np.vstack([w.T @ w, w.sum(0)])
                total = own if total is None else total + own
        if total is not None:
            k = total.shape[1]
            i, j = np.divmod(np.arange(total.size), k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    return run


def identity_error(rows: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows.

    Rows are centred, exactly, before they are projected; the mean that rounding leaves is taken off.
    """
    cells = rows.select("v").mapInArrow(_moments(n, sums, axes), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    k = axes.shape[1]
    total = np.zeros((k + 1, k))
    for row in cells.toArrow().to_pylist():
        total[row["i"], row["j"]] = row["value"]
    mean = total[k] / n
    return float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def _whitened(n, sums, axes):
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                centred, w = _projected(_whole(part.column(1)), n, sums, axes)
                deviation = pa.array((centred * centred).sum(1).tolist(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return run


def same_length(rows: DataFrame) -> DataFrame:
    """The rows whose vectors have the commonest length, the longest of several such."""
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("v") == (sizes["size"] if sizes else 0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    rows = same_length(usable(vectors, id_col, vector_col))
    id_type = vectors.select(F.col(id_col)).schema[0].dataType.simpleString()
    n, exact, products, spread = scatter(rows)
    axes, values, trace = components(n, exact, products, most) if n else (np.zeros((0, 0)),) * 2 + (0.0,)
    schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    sums = _exact(n, exact, spread)
    axes = axes / np.sqrt(values)
    error = identity_error(rows, n, sums, axes)
    each = rows.mapInArrow(_whitened(n, sums, axes), f"vec_id {id_type}, deviation bigint, whitened array<double>")
    explained = F.array(*(F.lit(float(v / trace)) for v in values))
    out = each.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error")
    )
