"""Connected components by alternating star operations on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller) neighbours are linked with its smallest neighbour.

    Only a minimum per node is gathered, with partial sums before the shuffle. The
    minima are stored, so both sides of the join are shuffled for it and Spark splits
    the partition of a hub among tasks.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    pairs = both.join(least, "u")
    moved = pairs.where("v > u") if large else pairs
    out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every linked node; links has the columns a and b of one orderable type.

    component is the smallest node reachable. Nulls and self-links are ignored.
    The links of each round are checkpointed; only a count and a digest come to the driver.
    """
    state = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialise(state)
    seen = None
    for _ in range(max_rounds):
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return state.groupBy("u").agg(F.min("v").alias("v")).selectExpr("u as node", "v as component").unionByName(state.selectExpr("v as node", "v as component").distinct())
        seen = mark
        state = materialise(_star(_star(state, large=True), large=False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
