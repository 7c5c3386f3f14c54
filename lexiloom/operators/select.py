"""The best k of any number of rows, without sorting them.

Which rows belong to the best k is a predicate: their (score, tie) is at or above
that of the k-th row. The k-th row is found by histograms. The first one counts rows
in quarter powers of two of the score; the bucket in which the k-th row lies is
divided again, between its least and its largest score, until its rows are few or
have one score; equal scores are told apart by the bytes of the tie column, one
after the other. Only counts come to the driver, and at the end the few rows around
the border, so no task sees more than its own share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a histogram; a bucket of so few rows is sorted by the driver.
BUCKETS, FEW = 4096, 5000


def _coarse(x: Column) -> Column:
    """Numbers that grow with x: four for each power of two."""
    size = F.floor((F.log2(F.abs(x)) + 1100) * 4) + 1
    wide = F.lit(10_000)
    return F.when(F.isnan(x), wide + 1).when(F.abs(x) == float("inf"), F.signum(x) * wide).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("bigint")


def _crossing(counts: list, need: int):
    """(the bucket that holds row need from the top, rows above it) of (bucket, n, ...) rows."""
    above = 0
    for row in sorted(counts, key=lambda r: r["bucket"], reverse=True):
        if above + row["n"] >= need:
            return row, above
        above += row["n"]
    raise AssertionError("fewer rows than counted")


def best_k(rows: DataFrame, k: int, score: Column, tie: Column) -> DataFrame:
    """The k rows with the largest score, of equal scores those with the larger tie (a string, compared by bytes).

    rows is read once for each histogram, so it should be stored. A null score
    counts as minus infinity, NaN as more than infinity, a null tie as empty. Of
    rows that are equal in both any stay. A k of 0 or less gives no rows.
    """
    total = rows.count() if k > 0 else 0
    if k >= total:
        return rows if k > 0 else rows.limit(0)
    value = F.coalesce(score.cast("double"), F.lit(float("-inf"))) + F.lit(0.0)
    text = F.coalesce(tie.cast("string"), F.lit(""))
    keyed = rows.select(value.alias("value"), text.alias("tie"))

    inside, need, size, bucket = F.lit(True), k, total, _coarse(F.col("value"))
    low = high = None
    while size > FEW and (low is None or low < high):
        counts = keyed.where(inside).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
        row, above = _crossing(counts, need)
        need, size, low, high = need - above, row["n"], row["low"], row["high"]
        inside = F.col("value").between(low, high)
        if low < high:
            bucket = F.floor((F.col("value") - low) / (high - low) * (BUCKETS - 1))
    at = 0
    while size > FEW:  # all of one score
        byte = F.hex(F.substring(F.col("tie").cast("binary"), at + 1, 1))
        row, above = _crossing(keyed.where(inside).groupBy(byte.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect(), need)
        need, size, at = need - above, row["n"], at + 1
        inside = inside & (byte == row["bucket"])
        if not row["bucket"]:  # equal in everything
            break
    # a group of equal rows may be of any size; of them one is enough
    border = keyed.where(inside).groupBy("value", "tie").agg(F.count(F.lit(1)).alias("n")).collect()
    nan_last = lambda r: (r["value"] != r["value"], r["value"], r["tie"].encode())
    for row in sorted(border, key=nan_last, reverse=True):
        if row["n"] >= need:
            break
        need -= row["n"]
    last_value, last_tie, equal = row["value"], row["tie"], row["n"]
    at_border = (value == last_value) & (text == last_tie)
    better = (value > last_value) | ((value == last_value) & (text > last_tie))
    if need == equal:
        return rows.where(better | at_border)
    return rows.where(better).unionByName(rows.where(at_border).limit(need))
