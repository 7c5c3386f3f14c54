"""Conversion of texts by tables of phrases and characters, the longest match first.

A conversion is a chain of steps. A step is a group of tables: at each place of the
text the longest entry of any of them is replaced, of entries of one length that of
the first table; what no table has stays. The next step works on the result. Up to
MOST_PHRASES entries go to the tasks as an automaton; larger tables are joined with
the distinct pieces of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import spans

MOST_PHRASES = 1_000_000
#: Bytes of the texts that get their entries together where tables are joined.
GROUP = 1 << 22
#: Pieces of texts whose conversion a worker remembers.
PIECES_KNOWN = 50_000
#: A piece of so many letters is worth an automaton of its own entries.
LONG_PIECE = 64


def kinds_of(letters: Iterable[str]) -> np.ndarray:
    """For every code point 1 if it is among letters, else 2. No entry of those letters reaches over a change of kind."""
    kinds = np.full(0x110000, 2, np.uint8)
    kinds[[ord(c) for c in letters]] = 1
    return kinds


class Automaton:
    """Finds the longest entry at a place by following one edge for each character."""

    def __init__(self, *tables: Mapping[str, str]):
        #: State and character to state; what a state replaces.
        self.edges: dict[tuple[int, str], int] = {}
        self.targets: dict[int, str] = {}
        for table in tables:
            for source, target in table.items():
                state = 0
                for c in source:
                    state = self.edges.setdefault((state, c), len(self.edges) + 1)
                if state:
                    self.targets.setdefault(state, target)
        first = "".join(sorted(re.escape(c) for state, c in self.edges if not state))
        self.first = re.compile(f"[{first}]") if first else None

    def convert(self, text: str) -> str:
        if self.first is None:
            return text
        out, done, edges, targets = [], 0, self.edges, self.targets
        start = self.first.search(text)
        while start:
            at = i = start.start()
            state, end, target = 0, at, None
            for i in range(at, len(text)):
                state = edges.get((state, text[i]))
                if state is None:
                    break
                if state in targets:
                    end, target = i + 1, targets[state]
            if target is not None:
                out += [text[done:at], target]
                done = end
            start = self.first.search(text, max(end, at + 1))
        return text[:] if not out else "".join([*out, text[done:]])

    def convert_all(self, texts: pa.Array) -> pa.Array:
        """texts converted; between letters that no entry has each distinct piece is converted once."""
        kinds = kinds_of({c for _, c in self.edges})
        known: dict[str, str] = {}

        def rewrite(pieces: list[str]) -> list[str]:
            if len(known) > PIECES_KNOWN:
                known.clear()
            known.update((p, self.convert(p)) for p in pieces if p not in known)
            return [known[p] for p in pieces]

        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        done = [spans.rewritten(part.column(0), kinds, rewrite) for part in spans.parts(batch)]
        return pa.concat_arrays(done) if done else texts


#: A step: a table, or several of which the first has priority.
Step = Mapping[str, str] | Sequence[Mapping[str, str]]


def automata(steps: Sequence[Step]) -> list[Automaton]:
    return [Automaton(*([s] if isinstance(s, Mapping) else s)) for s in steps]


def converter(spark: SparkSession, *steps: Step) -> Callable[[Column], Column]:
    """A Column function that applies the steps one after the other. Null stays null. Without entries it changes nothing."""
    tables = [t for s in steps for t in ([s] if isinstance(s, Mapping) else s)]
    if sum(map(len, tables)) > MOST_PHRASES:
        raise ValueError(f"tables with over {MOST_PHRASES} entries are joined: convert_joined()")
    if not any(tables):
        return lambda text: text
    if all(len(a) == 1 and len(b) == 1 and ord(max(a, b)) < 0x10000 for t in tables for a, b in t.items()):
        # single characters only: stays inside the JVM
        def translated(text: Column) -> Column:
            for step in steps:
                merged: dict[str, str] = {}
                for t in [step] if isinstance(step, Mapping) else step:
                    merged = {**t, **merged}
                text = F.translate(text, "".join(merged), "".join(merged.values())) if merged else text
            return text

        return translated
    shared = spark.sparkContext.broadcast(automata(steps))

    @F.arrow_udf("string")
    def convert(texts: pa.Array) -> pa.Array:
        for automaton in shared.value:
            texts = automaton.convert_all(texts)
        return texts

    return lambda text: convert(F.make_valid_utf8(text))


def phrase_converter(spark: SparkSession, mapping: Mapping[str, str]) -> Callable[[Column], Column]:
    """A Column function that replaces phrases in one step."""
    return converter(spark, mapping)


def single_targets(table: DataFrame) -> DataFrame:
    """(source, target) with one target for each source, the least of several."""
    return table.where("source <> ''").groupBy("source").agg(F.min("target").alias("target"))


def collected(table: DataFrame) -> dict[str, str] | None:
    """The table as a dictionary, or None where it has over MOST_PHRASES entries."""
    rows = single_targets(table).limit(MOST_PHRASES + 1).toArrow()
    return dict(zip(rows["source"].to_pylist(), rows["target"].to_pylist(), strict=True)) if len(rows) <= MOST_PHRASES else None


def _converted_by(piece: str, entries: dict[str, str]) -> str:
    if len(piece) > LONG_PIECE:
        return Automaton(entries).convert(piece)
    longest, out, at = max(map(len, entries)), [], 0
    while at < len(piece):
        size = next((k for k in range(min(longest, len(piece) - at), 0, -1) if piece[at : at + k] in entries), 0)
        out.append(entries[piece[at : at + size]] if size else piece[at])
        at += size or 1
    return "".join(out)


def _own_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, converted) of pieces (piece, found) that their own entries change."""
    for batch in batches:
        pieces = batch.column(0).to_pylist()
        found = batch.column(1)
        ends, words, targets = (x.to_pylist() for x in (found.value_lengths(), found.flatten().field("word"), found.flatten().field("target")))
        new, first = [], 0
        for piece, size in zip(pieces, ends, strict=True):
            new.append(_converted_by(piece, dict(zip(words[first : first + size], targets[first : first + size], strict=True))))
            first += size
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["piece", "converted"])


def _grouped(at: int):
    """Rows with the number of the group of texts that they belong to behind their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in spans.parts(batch, at, GROUP):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, number))], names=[*part.schema.names, "group"])
                number += 1

    return run


def _pieces_of(kinds: np.ndarray):
    """(group, piece): the distinct pieces of letters of kind 1 in texts (text, group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(1).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, groups[1:] != groups[:-1])), len(groups))
            for first, end in zip(edges[:-1], edges[1:], strict=True) if len(groups) else ():
                letters = spans.Letters(batch.column(0).slice(first, end - first))
                own = kinds[letters.points]
                begin, pieces, _ = letters.pieces(own)
                pieces = pieces.filter(pa.array(own[begin] == 1)).unique()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pieces), groups[first])), pieces], names=["group", "piece"])

    return run


def _rewritten(at: int, kinds: np.ndarray):
    """The rows of a group with their texts converted by its pieces (group, piece, converted)."""

    def run(rows: pa.Table, pieces: pa.Table) -> pa.Table:
        known = dict(zip(pieces["piece"].to_pylist(), pieces["converted"].to_pylist(), strict=True))
        texts = rows.column(at).combine_chunks()
        new = spans.rewritten(texts, kinds, lambda own: [known.get(p, p) for p in own])
        return rows.set_column(at, rows.schema.names[at], new).drop_columns([rows.schema.names[-1]])

    return run


def convert_joined(rows: DataFrame, text_col: str, *tables: DataFrame) -> DataFrame:
    """rows with text_col converted by tables (source, target) of any size, one step each. Every row stays, whatever its other columns.

    Texts fall into pieces between letters that no entry has. The distinct pieces of
    the whole corpus are joined with the table and converted once; what of them
    changes goes to the groups of texts that have it.
    """
    from ..operators.occurring import longest_of, occurring
    from ..storage import materialise

    at = rows.columns.index(text_col)
    for table in tables:
        words = materialise(single_targets(table).select(F.col("source").alias("word"), "target"))
        kinds = kinds_of(r["ch"] for r in words.select("word").mapInArrow(spans.letters_counted, "ch string, n bigint").select("ch").distinct().collect())
        # names without dots, and one more for the group
        names = [f"c{k}" for k in range(len(rows.columns))]
        plain = rows.toDF(*names)
        plain = plain.withColumn(names[at], F.make_valid_utf8(names[at]))
        keyed = materialise(plain.mapInArrow(_grouped(at), StructType([*plain.schema.fields, StructField("group", LongType())])))
        pieces = materialise(keyed.select(names[at], "group").mapInArrow(_pieces_of(kinds), "group bigint, piece string"))
        once = materialise(pieces.select("piece").distinct().select(F.monotonically_increasing_id().alias("no"), "piece"))
        found = occurring(once, "no", "piece", words, longest_of(words))
        changed = once.join(found, "no").select("piece", "found").mapInArrow(_own_entries, "piece string, converted string").where("piece <> converted")
        parts = pieces.join(changed, "piece").select("group", "piece", "converted")
        rows = keyed.groupBy("group").cogroup(parts.groupBy("group")).applyInArrow(_rewritten(at, kinds), plain.schema).toDF(*rows.columns)
    return rows


def convert(rows: DataFrame, text_col: str, *tables: DataFrame, engine: str = "auto") -> DataFrame:
    """rows with text_col converted by tables (source, target), one step each; tables that are too large for the tasks, or all with engine "join", are joined."""
    for table in tables:
        small = collected(table) if engine != "join" else None
        if small is None:
            rows = convert_joined(rows, text_col, table)
        else:
            rows = rows.withColumn(text_col, converter(rows.sparkSession, small)(F.col(text_col)))
    return rows


def converted(rows: DataFrame, text_col: str, mapping: Step | Sequence[Step] | None = None, tables: Sequence[DataFrame] = ()) -> DataFrame:
    """rows with text_col converted by mapping (a table, or steps one after the other), then by each of tables."""
    if mapping:
        steps = [mapping] if isinstance(mapping, Mapping) else mapping
        rows = rows.withColumn(text_col, converter(rows.sparkSession, *steps)(F.col(text_col)))
    return convert(rows, text_col, *tables)
