"""Suppression of titles in their given order, without one task that sees them all.

Whether a title stays depends on the last one that stayed. Titles are dealt in ranges
of the order; each range tells in one row what it does to any state that comes in,
the rows are passed over once, and then every range is filtered from its true state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.convert import converted
from ..storage import materialise

#: Titles that are shorter suppress nothing.
LEAST_PREFIX = 4


def accepted(titles: list[str], before: str) -> tuple[list[bool], str]:
    """Which titles stay, one after the other, and the last that stayed: a title goes if it starts with that, and that has LEAST_PREFIX characters."""
    out = []
    for title in titles:
        stays = len(before) < LEAST_PREFIX or not title.startswith(before)
        if stays:
            before = title
        out.append(stays)
    return out, before


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, shared, last) of a range of (part, title) rows: what all titles start with, and which stays last if nothing comes in.

    Nothing more is needed. A state that comes in either suppresses all titles, as
    they all start with it, and stays; or there is a first title that doesn't start
    with it. That one stays, and it would stay without the state too: what stood
    before it starts with the state, and so it doesn't start with that. From there on
    all is the same.
    """
    part, shared, last = None, "", ""
    for batch in batches:
        numbers, titles = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if titles:
            shared = commonprefix([titles[0] if part is None else shared, *titles])
            part = numbers[0]
            last = accepted(titles, last)[1]
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shared]), pa.array([last])], names=["part", "shared", "last"])


def states(summaries: list[tuple[int, str, str]]) -> dict[int, str]:
    """The last title that stayed before each range, from (part, shared, last) of all."""
    state, out = "", {}
    for part, shared, last in sorted(summaries):
        out[part] = state
        if len(state) < LEAST_PREFIX or not shared.startswith(state):
            state = last
    return out


def suppress_in_order(titles: DataFrame, order_col: str = "line", title_col: str = "title") -> DataFrame:
    """titles without those that start with the last title that stayed before them, in the order of order_col.

    order_col holds no value twice. A title of under LEAST_PREFIX characters
    suppresses nothing, but the next one is measured against it. Null titles go. One
    row for each range comes to the driver.
    """
    rows = titles.where(F.col(title_col).isNotNull())
    part = max(rows.columns, key=len) + "_part"
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that both passes see the same ranges
    dealt = materialise(rows.repartitionByRange(ranges, order_col).sortWithinPartitions(order_col).withColumn(part, F.spark_partition_id()))
    summaries = dealt.select(part, title_col).mapInArrow(_summary, "part int, shared string, last string").collect()
    shared = rows.sparkSession.sparkContext.broadcast(states([tuple(r) for r in summaries]))
    at = dealt.columns.index(title_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows:
                if before is None:
                    before = shared.value[batch.column(batch.num_columns - 1)[0].as_py()]
                stay, before = accepted(batch.column(at).to_pylist(), before)
                yield batch.filter(pa.array(stay, pa.bool_()))

    return dealt.mapInArrow(kept, dealt.schema).drop(part)


def good_titles_in_order(titles: DataFrame, order_col: str = "line", title_col: str = "title", mapping=None, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """(order_col, title): titles to take words from, in any given order: converted by mapping and tables, of good form, and not continuing the last that stayed."""
    rows = converted(titles.select(order_col, T.strip(F.col(title_col)).alias("title")), "title", mapping, tables)
    return suppress_in_order(rows.where(T.is_good_title(F.col("title"))), order_col)
