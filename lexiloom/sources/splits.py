"""INSERT lines of any length, read in pieces.

A dump's lines hold megabytes of tuples. They are cut into pieces at any place. What
a piece means depends on where the one before ends: outside of a tuple, in one, in a
quoted field, or behind a backslash there. A first pass tells for each piece and each
of these states in which state it ends; chaining these small functions over a line
gives every piece its true state. A second pass takes the tuples that lie in a piece
and sends the parts of those that go over a border to be joined. Both passes and the
parsing run on pieces, dealt over all tasks, also where one task unpacked the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

#: Characters of a piece.
PIECE = 1 << 16

OUTSIDE, INSIDE, QUOTED, ESCAPED = range(4)
#: What ends each state but ESCAPED, which ends behind any character.
_ENDS = (re.compile(r"\("), re.compile(r"['()]"), re.compile(r"[\\']"))


def scan(text: str, state: int) -> tuple[int, list[tuple[int, int]], int, int]:
    """(state at the end, (start, end) of the tuples without parentheses, where the first tuple that was open ends, where the last one that is open starts).

    The places are -1 where there is no such tuple. A tuple that opens inside of
    another takes its place.
    """
    at, found = 0, []
    closes, opens = -1, -1
    was_open = state != OUTSIDE
    while at < len(text):
        if state == ESCAPED:
            state, at = QUOTED, at + 1
            continue
        mark = _ENDS[state].search(text, at)
        if mark is None:
            break
        at, c = mark.end(), mark[0]
        if c == "(":
            state, opens, was_open = INSIDE, at, False
        elif c == ")":
            if was_open:
                closes, was_open = at - 1, False
            else:
                found.append((opens, at - 1))
            state, opens = OUTSIDE, -1
        elif c == "\\":
            state = ESCAPED
        else:
            state = QUOTED if state == INSIDE else INSIDE
    return state, found, closes, opens


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece and state at its start the state at its end, and whether the tuple that is open then opened in the piece."""
    for batch in batches:
        ends, opened = [], []
        for text in batch.column(2).to_pylist():
            each = [scan(text, s) for s in range(4)]
            ends.append([x[0] for x in each])
            opened.append([x[3] >= 0 for x in each])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int32())), pa.array(opened, pa.list_(pa.bool_()))], names=["line", "no", "ends", "opened"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, owner, no, tuple, closed): whole tuples with no owner, and parts of others with the number of the piece in which they open; closed is the part that ends one."""
    for batch in batches:
        rows: list[tuple] = []
        for line, no, text, state, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            end, found, closes, opens = scan(text, state)
            rows += [(line, None, no, text[a:b], True) for a, b in found]
            if closes >= 0:
                rows.append((line, owner, no, text[:closes], True))
            elif state != OUTSIDE and end != OUTSIDE and opens < 0:
                rows.append((line, owner, no, text, False))
            if opens >= 0:
                rows.append((line, no, no, text[opens:], False))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)], names=["line", "owner", "no", "tuple", "closed"])


def _chained(pieces: Column) -> Column:
    """The state and the owner of the open tuple at the start of each piece of a line, from the sorted (no, ends, opened) of all."""

    def step(have: Column, piece: Column) -> Column:
        state = have["state"]
        end = F.get(piece["ends"], state)
        owner = F.when(end == OUTSIDE, F.lit(None).cast("int")).when(F.get(piece["opened"], state), piece["no"]).otherwise(have["owner"])
        starts = F.concat(have["starts"], F.array(F.struct(piece["no"].alias("no"), state.alias("state"), have["owner"].alias("owner"))))
        return F.struct(end.alias("state"), owner.alias("owner"), starts.alias("starts"))

    none = F.array().cast("array<struct<no:int,state:int,owner:int>>")
    return F.aggregate(pieces, F.struct(F.lit(OUTSIDE).alias("state"), F.lit(None).cast("int").alias("owner"), none.alias("starts")), step, lambda s: s["starts"])


def split_tuples(lines: DataFrame, line_col: str = "value", size: int = PIECE) -> DataFrame:
    """(tuple): the text of each tuple of INSERT lines, whatever the size of the pieces they are read in. Other lines have none; a tuple that never closes is none."""
    line = F.col(line_col)
    data = F.expr(f"substr({line_col}, instr({line_col}, 'VALUES ') + 7)")
    rows = lines.where(line.startswith("INSERT") & line.contains("VALUES ")).select(F.monotonically_increasing_id().alias("line"), data.alias("data"))
    parts = rows.select("line", F.posexplode(F.regexp_extract_all("data", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))).alias("no", "text"))
    # dealt over all tasks: a compressed file is read by one
    pieces = materialise(parts.repartition("line", "no"))
    ends = pieces.mapInArrow(_ends, "line bigint, no int, ends array<int>, opened array<boolean>")
    starts = ends.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("no", "ends", "opened"))).alias("pieces"))
    states = starts.select("line", F.explode(_chained(F.col("pieces"))).alias("s")).select("line", "s.no", "s.state", "s.owner")
    taken = materialise(pieces.join(states, ["line", "no"]).select("line", "no", "text", "state", "owner").mapInArrow(_taken, "line bigint, owner int, no int, tuple string, closed boolean"))
    joined = taken.where("owner is not null").groupBy("line", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "tuple"))), lambda x: x["tuple"]), "").alias("tuple"), F.max("closed").alias("closed"))
    return taken.where("owner is null").select("tuple").unionByName(joined.where("closed").select("tuple"))
