"""Segmentation as DataFrame operators.

Path search is a function of the run alone: counts and losses do it once per
distinct run and weigh it by how often the run occurs; whole documents are cut
where they are, without a shuffle. Three engines give the same words: "arrow" looks
words up in a broadcast lexicon of checked size, "index" in a sorted index of checked
size that the workers of an executor share, "native" joins the lexicon and searches
with higher-order functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import charclass, spans
from ..functions import text as T
from ..storage import materialise
from . import index, kernels, vector
from .lexicon import word_scores
from .occurring import free_pieces, longest_of, occurring

#: Above this many words the lexicon isn't broadcast to Python; it is indexed or joined.
BROADCAST_WORDS = 1_000_000
#: Runs of over so many characters come in pieces where the lexicon is joined.
LONG_RUN = 256
#: Rows whose distinct chunks a worker holds as Python strings at once.
ROWS_AT_ONCE = 256
#: Chunks whose words a worker remembers.
CHUNKS_KNOWN = 50_000


def chunk_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(chunk, n, han): distinct pre-tokens of the corpus and how often they occur."""
    return _counted(corpus, text_col, lambda texts: (spans.named(spans.pretokens(texts)[0]),)).withColumn("han", T.is_han_run(F.col("chunk")))


def _counted(corpus: DataFrame, text_col: str, split: Callable) -> DataFrame:
    """(chunk, n): the distinct pieces of all texts, counted in the tasks before they are shuffled."""
    pieces = corpus.select(F.make_valid_utf8(F.col(text_col))).mapInArrow(spans.counted(split), "chunk string, n bigint")
    return pieces.groupBy("chunk").agg(F.sum("n").alias("n"))


def runs_of(chunks: DataFrame) -> DataFrame:
    return chunks.where("han").select("chunk", "n")


#: Cuts many runs.
Paths = Callable[[list[str]], list[list[str]]]


class Model:
    """A scored lexicon, collected for broadcast if it has at most BROADCAST_WORDS words."""

    def __init__(self, lexicon: DataFrame, limit: int | None = None):
        limit = BROADCAST_WORDS if limit is None else limit
        self.frame = word_scores(lexicon)
        rows = self.frame.limit(limit + 1).toArrow()
        self.small = rows.num_rows <= limit
        self.scores = dict(zip(rows["word"].to_pylist(), rows["lp"].to_pylist(), strict=True)) if self.small else {}
        self.unknown = rows["unknown"][0].as_py() if rows.num_rows else 0.0
        if self.small:
            self.count, self.longest = len(self.scores), max(map(len, self.scores), default=1)
        else:
            self.count, self.longest = self.frame.agg(F.count("*"), F.max(F.char_length("word"))).first()
        self._shared = self._files = self._trie = None

    def broadcast(self, spark: SparkSession):
        if self._shared is None:
            self._shared = spark.sparkContext.broadcast((self.scores, self.unknown, self.longest))
        return self._shared

    def trie(self, spark: SparkSession):
        """The words for vector.py, where the lexicon is small."""
        if self._trie is None:
            self._trie = spark.sparkContext.broadcast(vector.Trie(self.scores, self.unknown))
        return self._trie

    def paths(self, spark: SparkSession, engine: str = "auto") -> Paths | None:
        """Cuts runs in tasks; None where the lexicon is to be joined. The index is written once a model."""
        if engine == "native" or (self.count > index.INDEX_WORDS and not self.small):
            return None
        if self.small and engine != "index":
            shared = self.broadcast(spark)
            return lambda runs: [kernels.best_path(r, *shared.value) for r in runs]
        if self._files is None:
            self._files = index.write_index(self.frame, self.count)
        files, unknown = self._files, self.unknown
        return lambda runs: index.best_paths(runs, files.open(), unknown)

    def release(self) -> None:
        """Take the broadcast off the executors; a later use sends it again."""
        for shared in (self._shared, self._trie):
            if shared is not None:
                shared.unpersist()


def _cut_column(paths: Paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = paths(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.string()))], names=[*batch.schema.names, "tokens"])

    return run


def lattice(runs: DataFrame, scores: DataFrame, longest: int) -> DataFrame:
    """(chunk, pos, len, lp): every lexicon word in every run, and a single character at every position."""
    places = runs.select("chunk").distinct().select("chunk", F.explode(F.sequence(F.lit(1), F.char_length("chunk"))).alias("pos"))
    sizes = places.select("chunk", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length("chunk") - F.col("pos") + 1))).alias("len"))
    words = sizes.withColumn("word", F.substring("chunk", F.col("pos"), F.col("len")))
    unknown = scores.agg(F.first("unknown").alias("_unknown"))  # one row
    joined = words.join(scores.select("word", "lp"), "word", "left").crossJoin(F.broadcast(unknown))
    found = joined.where("lp is not null or len = 1")
    return found.select("chunk", "pos", "len", F.coalesce("lp", "_unknown", F.lit(0.0)).alias("lp"))


def _by_pieces(runs: DataFrame, words: DataFrame, longest: int, cut_pieces: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(chunk, tokens) of distinct runs by cut_pieces, a function of (chunk) to (chunk, tokens).

    Runs of over LONG_RUN characters are cut in pieces at places over which no word
    stands: the longest match of the run is that of each piece.
    """
    short, long = runs.where(F.char_length("chunk") <= LONG_RUN).select("chunk"), runs.where(F.char_length("chunk") > LONG_RUN).select("chunk")
    if long.isEmpty():
        return cut_pieces(short)
    keyed = materialise(long.select(F.monotonically_increasing_id().alias("run"), "chunk"))
    pieces = materialise(free_pieces(keyed, "run", "chunk", words, longest, LONG_RUN // 2))
    cuts = cut_pieces(pieces.select(F.col("piece").alias("chunk")).distinct())
    tokens = pieces.join(cuts, pieces["piece"] == cuts["chunk"]).groupBy("run").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "tokens"))), lambda x: x["tokens"])).alias("tokens"))
    return cut_pieces(short).unionByName(keyed.join(tokens, "run").select("chunk", "tokens"))


def _with_own_words(runs: DataFrame, scores: DataFrame, longest: int, function: Callable) -> DataFrame:
    """(chunk, tokens) of distinct runs of any length: each comes with the words of scores (word, lp, unknown) that stand in it, and function takes the run, their scores, an unknown word's and the greatest length."""
    unknown = scores.agg(F.first("unknown")).first()[0] or 0.0
    keyed = materialise(runs.select(F.monotonically_increasing_id().alias("run"), "chunk"))
    found = occurring(keyed, "run", "chunk", scores.select("word", "lp"), longest)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column(0), batch.column(1), strict=True):
                known = {w["word"]: w["lp"] for w in words.as_py() or ()}
                tokens = function(chunk.as_py(), known, unknown, longest)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([tokens], pa.list_(pa.string()))], names=["chunk", "tokens"])

    return keyed.join(found, "run", "left").select("chunk", "found").mapInArrow(own, "chunk string, tokens array<string>")


def cut_native(runs: DataFrame, scores: DataFrame, longest: int) -> DataFrame:
    """(chunk, tokens) of distinct runs with a join of the lexicon.

    Higher-order functions search the lattice. Their arrays cost the square of a run's
    length, so a long run is searched by the kernel with the words that it has: as a
    whole, since which of two equal paths is taken depends on how sums over it round.
    """

    short, long = runs.where(F.char_length("chunk") <= LONG_RUN), runs.where(F.char_length("chunk") > LONG_RUN)
    out = _searched(short, scores, longest)
    return out if long.isEmpty() else out.unionByName(_with_own_words(long, scores, longest, kernels.best_path))


def _searched(runs: DataFrame, scores: DataFrame, longest: int) -> DataFrame:
    """(chunk, tokens) by higher-order functions over the lattice of short runs."""
    edges = lattice(runs, scores, longest).groupBy("chunk", "pos").agg(F.collect_list(F.struct("len", "lp")).alias("edges"))
    packed = edges.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edges"))), lambda x: x["edges"]).alias("edges"))

    # ways[0] is the best way from the next place on: its score and the length of its first word
    def step(ways: Column, here: Column) -> Column:
        options = F.transform(here, lambda e: F.struct((e["lp"] + F.get(ways, e["len"] - 1)["score"]).alias("score"), (-e["len"]).alias("back")))
        return F.concat(F.array(F.array_max(options)), ways)

    end = F.array(F.struct(F.lit(1.0).alias("score"), F.lit(0).alias("back")))
    ways = packed.select("chunk", F.aggregate(F.reverse("edges"), end, step).alias("ways"))

    return ways.select("chunk", _walked(lambda at: -F.get("ways", at - 1)["back"]).alias("tokens"))


def _walked(size_at) -> Column:
    """The words of chunk where size_at(place) tells the length of the word that starts there."""

    def walk(state: Column, at: Column) -> Column:
        size = size_at(at)
        taken = F.struct((at + size).alias("at"), F.concat(state["tokens"], F.array(F.substring("chunk", at, size))).alias("tokens"))
        return F.when(at == state["at"], taken).otherwise(state)

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("tokens"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length("chunk")), start, walk, lambda s: s["tokens"])


def match_native(segments: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, tokens) by longest match, with a join of the lexicon instead of a broadcast."""
    longest = longest_of(words)
    known = words.select("word", F.lit(0.0).alias("lp"), F.lit(0.0).alias("unknown"))

    def match_pieces(pieces: DataFrame) -> DataFrame:
        small, large = pieces.where(F.char_length("chunk") <= LONG_RUN), pieces.where(F.char_length("chunk") > LONG_RUN)
        sizes = lattice(small, known, longest).groupBy("chunk", "pos").agg(F.max("len").alias("len"))
        packed = sizes.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "len"))), lambda x: x["len"]).alias("sizes"))
        out = packed.select("chunk", _walked(lambda at: F.get("sizes", at - 1)).alias("tokens"))
        return out if large.isEmpty() else out.unionByName(_with_own_words(large, known, longest, lambda run, own, _, most: kernels.longest_match(run, own, most)))

    return _by_pieces(segments, words, longest, match_pieces)


def cut_runs(runs: DataFrame, lexicon: DataFrame, engine: str = "auto") -> DataFrame:
    """(chunk, tokens) of distinct runs; a lexicon without words gives single characters."""
    model = Model(lexicon)
    if model.small and engine not in ("native", "index"):
        return runs.select("chunk").mapInArrow(vector.cut_column(model.trie(runs.sparkSession)), "chunk string, tokens array<string>")
    # training cuts with many lexicons, and the session would keep the files of each
    paths = model.paths(runs.sparkSession, "native" if engine == "auto" and not model.small else engine)
    if paths is None:
        return cut_native(runs, model.frame, model.longest)
    return runs.select("chunk").mapInArrow(_cut_column(paths), "chunk string, tokens array<string>")


def _learn(known: dict[str, list[str]], chunks: Iterable[str], paths: Paths, stays: re.Pattern) -> None:
    """Put the words of all chunks into known, where those that match stays are one word."""
    new = [c for c in dict.fromkeys(chunks) if c not in known]
    known.update((c, [c]) for c in new if stays.match(c))
    cut = [c for c in new if c not in known]
    known.update(zip(cut, paths(cut), strict=True))


def _rows_mapped(rows: DataFrame, paths: Paths, whole: str, split: Callable, named: Callable = lambda chunks: chunks) -> DataFrame:
    """(id, tokens) of rows (id, text), which split cuts into chunks, called as named tells: those that match the pattern whole stay, the others go through paths, seldom more than once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stays = re.compile(whole)
        known: dict[str, list[str]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                for part in spans.parts(batch.slice(start, ROWS_AT_ONCE), 1):
                    chunks, before = split(part.column(1))
                    # only distinct chunks become Python strings
                    chunks = chunks.dictionary_encode()
                    distinct = named(chunks.dictionary).to_pylist()
                    if len(known) > CHUNKS_KNOWN:
                        known.clear()
                    _learn(known, distinct, paths, stays)
                    cuts = pa.array([known[c] for c in distinct], pa.list_(pa.string())).take(chunks.indices)
                    ends = np.concatenate([[0], np.cumsum(cuts.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
                    out = pa.ListArray.from_arrays(pa.array(ends[before], pa.int32()), cuts.flatten())
                    yield pa.RecordBatch.from_arrays([part.column(0), out], names=[batch.schema.names[0], "tokens"])

    return rows.mapInArrow(run, StructType([rows.schema[0], StructField("tokens", ArrayType(StringType()))]))


def _rows_joined(rows: DataFrame, whole: Column, cut_chunks) -> DataFrame:
    """The same with a join: rows get a key of their own, so rows with one id keep apart; chunks that stay aren't shuffled for the join."""
    id_col = rows.columns[0]
    keyed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = keyed.select("_row", id_col, F.posexplode_outer("chunks").alias("no", "chunk"))
    cuts = cut_chunks(parts.where(~whole).select("chunk").distinct())
    tokens = parts.where(~whole).join(cuts, "chunk").select("_row", id_col, "no", "tokens").unionByName(parts.where(whole | F.col("chunk").isNull()).select("_row", id_col, "no", F.when(F.col("chunk").isNotNull(), F.array("chunk")).alias("tokens")))
    # tokens are null only where a text has no chunks at all
    gathered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "tokens"))), lambda x: F.coalesce(x["tokens"], F.array().cast("array<string>"))))
    return tokens.groupBy("_row").agg(F.first(id_col).alias(id_col), gathered.alias("tokens")).drop("_row")


def cut(corpus: DataFrame, lexicon: DataFrame | Model, id_col: str = "doc_id", text_col: str = "text", engine: str = "auto") -> DataFrame:
    """(id, tokens): every text cut into words, one row for each row of corpus, whatever its id. Texts without tokens have an empty array."""
    model = lexicon if isinstance(lexicon, Model) else Model(lexicon)
    paths = model.paths(corpus.sparkSession, engine)
    if paths is None:
        rows = corpus.select(F.col(id_col), T.pretokenize(T.normalize_spaces(F.col(text_col))).alias("chunks"))
        return _rows_joined(rows, ~T.is_han_run(F.col("chunk")), lambda runs: cut_native(runs, model.frame, model.longest))
    rows = corpus.select(F.col(id_col), F.make_valid_utf8(F.col(text_col)).alias("text"))
    return _rows_mapped(rows, paths, charclass.python_class(charclass.HAN, inside=False), spans.pretokens, spans.named)


def token_counts(chunks: DataFrame, lexicon: DataFrame, only_lexicon: bool = False, engine: str = "auto") -> DataFrame:
    """(word, freq) of the cut corpus, from its chunk counts. only_lexicon keeps words of the lexicon; an empty one keeps all."""
    model = Model(lexicon) if engine not in ("native", "index") else None
    if model and model.small:
        # words are counted where their runs are cut, and no run is shuffled
        own = runs_of(chunks).mapInArrow(vector.counted_tokens(model.trie(chunks.sparkSession)), "word string, n bigint")
        return count_words(own.unionByName(chunks.where("not han").select(F.col("chunk").alias("word"), "n")), lexicon if only_lexicon else None)
    cuts = cut_runs(runs_of(chunks), lexicon, engine)
    tokens = chunks.join(cuts, "chunk", "left").select("n", F.explode(F.coalesce("tokens", F.array("chunk"))).alias("word"))
    return count_words(tokens, lexicon if only_lexicon else None)


def count_words(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(word, freq) of valid words in (word, n)."""
    valid = tokens.where(T.is_valid_word(F.col("word")))
    counts = valid.groupBy("word").agg(F.sum("n").alias("freq"))
    if lexicon is None:
        return counts
    kept = lexicon.select("word").where("word <> ''").distinct()
    return counts if kept.isEmpty() else counts.join(kept, "word", "left_semi")


def recount(lines: DataFrame, lexicon: DataFrame | None = None, line_col: str = "value") -> DataFrame:
    """(word, freq) of segmented lines, split at U+0020."""
    return count_words(lines.select(F.explode(F.split(line_col, " ")).alias("word"), F.lit(1).alias("n")).where("word <> ''"), lexicon)


def punct_segments(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(chunk, n, delimiter): distinct delimiters and what stands between them."""
    return _counted(corpus, text_col, spans.segments).withColumn("delimiter", T.is_punct(F.col("chunk")))


def _matches(words: DataFrame, engine: str) -> Paths | None:
    """Cuts segments by longest match in tasks; None where the words are to be joined."""
    if engine == "native":
        return None
    if engine != "index":
        rows = words.limit(BROADCAST_WORDS + 1).toArrow()
        if rows.num_rows <= BROADCAST_WORDS:
            known = set(rows["word"].to_pylist())
            shared = words.sparkSession.sparkContext.broadcast((known, max(map(len, known), default=1)))
            return lambda segments: [kernels.longest_match(s, *shared.value) for s in segments]
    count = words.count()
    if count > index.INDEX_WORDS:
        return None
    files = index.write_index(words.select("word", F.lit(0.0).alias("lp")), count)
    return lambda segments: index.longest_matches(segments, files.open())


def _match_trie(words: DataFrame):
    """The words for vector.py; None where they are too many."""
    rows = words.limit(BROADCAST_WORDS + 1).toArrow()
    if rows.num_rows > BROADCAST_WORDS:
        return None
    return words.sparkSession.sparkContext.broadcast(vector.Trie(dict.fromkeys(rows["word"].to_pylist(), 0.0)))


def match_segments(segments: DataFrame, lexicon: DataFrame, engine: str = "auto") -> DataFrame:
    """(chunk, tokens) of distinct segments by longest match."""
    words = lexicon.select("word").where("word <> ''").distinct()
    trie = _match_trie(words) if engine not in ("native", "index") else None
    if trie:
        return segments.select("chunk").mapInArrow(vector.cut_column(trie, match=True), "chunk string, tokens array<string>")
    paths = _matches(words, engine)
    if paths is None:
        return match_native(segments, words)
    return segments.select("chunk").mapInArrow(_cut_column(paths), "chunk string, tokens array<string>")


def segment_longest_match(corpus: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", engine: str = "auto") -> DataFrame:
    """(id, tokens) by longest match between delimiters, one row for each row of corpus; blanks aren't normalised."""
    words = lexicon.select("word").where("word <> ''").distinct()
    paths = _matches(words, engine)
    if paths is None:
        rows = corpus.select(F.col(id_col), T.split_punct(F.col(text_col)).alias("chunks"))
        return _rows_joined(rows, T.is_punct(F.col("chunk")), lambda segments: match_native(segments, words))
    rows = corpus.select(F.col(id_col), F.make_valid_utf8(F.col(text_col)).alias("text"))
    return _rows_mapped(rows, paths, charclass.python_class(charclass.PUNCT), spans.segments)


def match_counts(corpus: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) of longest-match tokens that the lexicon has: the start of training."""
    parts = punct_segments(corpus, text_col)
    words = lexicon.select("word").where("word <> ''").distinct()
    trie = _match_trie(words)
    if trie:
        # words are counted where their segments are cut, also of segments that come several times
        pieces = corpus.select(F.make_valid_utf8(F.col(text_col))).mapInArrow(spans.counted(spans.segments), "chunk string, n bigint")
        longest = pieces.where(~T.is_punct(F.col("chunk"))).mapInArrow(vector.counted_tokens(trie, match=True), "word string, n bigint")
        return count_words(longest.unionByName(pieces.where(T.is_punct(F.col("chunk"))).select(F.col("chunk").alias("word"), "n")), lexicon)
    cuts = match_segments(parts.where("not delimiter"), lexicon)
    tokens = parts.join(cuts, "chunk", "left").select("n", F.explode(F.coalesce("tokens", F.array("chunk"))).alias("word"))
    return count_words(tokens, lexicon)


def word_loss(chunks: DataFrame, lexicon: DataFrame, engine: str = "auto") -> DataFrame:
    """(word, loss, cnt) for every lexicon word: what the best paths lose without it, and how often they have it.

    A lexicon that is too large for a broadcast, or engine "join", is joined with
    the runs' substrings, so each run comes with the words that stand in it.
    """
    model = Model(lexicon)
    runs = runs_of(chunks).select("chunk", "n")
    kind = pa.list_(pa.struct([("word", pa.string()), ("loss", pa.float64())]))
    schema = "chunk string, n bigint, tokens array<struct<word:string,loss:double>>"
    as_rows = lambda c, *m: [{"word": w, "loss": x} for w, x in kernels.path_losses(c, *m)]
    if model.small and engine != "join":
        summed = runs.mapInArrow(vector.summed_losses(model.trie(runs.sparkSession)), "word string, loss double, cnt bigint")
        sums = summed.groupBy("word").agg(F.sum("loss").alias("loss"), F.sum("cnt").alias("cnt"))
    else:
        unknown, longest = model.unknown, model.longest

        def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
                out = [as_rows(c, {w["word"]: w["lp"] for w in words or ()}, unknown, longest) for c, words in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["chunk", "n", "tokens"])

        # long runs come in pieces over whose borders no word stands: a word's loss is the same there
        long = runs.where(F.char_length("chunk") > LONG_RUN)
        if not long.isEmpty():
            keyed = materialise(long.select(F.monotonically_increasing_id().alias("run"), "chunk", "n"))
            pieces = free_pieces(keyed, "run", "chunk", model.frame, longest, LONG_RUN // 2).join(keyed.select("run", "n"), "run").groupBy(F.col("piece").alias("chunk")).agg(F.sum("n").alias("n"))
            runs = runs.where(F.char_length("chunk") <= LONG_RUN).unionByName(pieces)
        keyed = materialise(runs.select(F.monotonically_increasing_id().alias("run"), "chunk", "n"))
        words = occurring(keyed, "run", "chunk", model.frame.select("word", "lp"), longest)
        found = keyed.join(words, "run", "left").select("chunk", "n", F.col("found").alias("words")).mapInArrow(own_words, schema)
        sums = found.select("n", F.explode("tokens").alias("t")).groupBy("t.word").agg(F.sum(F.col("n") * F.col("t.loss")).alias("loss"), F.sum("n").alias("cnt"))
    words = lexicon.select("word").where("word <> ''").distinct()
    return words.join(sums, "word", "left").fillna({"loss": 0.0, "cnt": 0})


def cut_udf(spark: SparkSession, lexicon: DataFrame | Model):
    """A Column function that cuts pre-tokens: for streams and single rows."""
    paths = row_paths(spark, lexicon)

    @F.pandas_udf("array<string>")
    def cut_chunks(chunks):
        stays = re.compile(charclass.python_class(charclass.HAN, inside=False))
        known: dict[str, list[str]] = {}
        _learn(known, (c for own in chunks if own is not None for c in own), paths, stays)
        return chunks.map(lambda own: [w for c in own for w in known[c]] if own is not None else None)

    return lambda text: cut_chunks(T.pretokenize(T.normalize_spaces(text)))


def row_paths(spark: SparkSession, lexicon: DataFrame | Model) -> Paths:
    """Cuts runs row by row; raises where the lexicon has too many words for an index."""
    paths = (lexicon if isinstance(lexicon, Model) else Model(lexicon)).paths(spark)
    if paths is None:
        raise ValueError(f"row-wise cutting takes lexicons of up to {index.INDEX_WORDS} words; cut() has no limit")
    return paths
