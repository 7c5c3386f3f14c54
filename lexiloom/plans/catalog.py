"""The registered queries over the shared tables, with their SQL counterparts.

The tables hold no ideographs, so the segmenter's queries read their texts with
ASCII letters turned into ideographs, in both engines alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charclass as C
from ..functions import convert, spans
from ..functions import text as T
from ..operators import lexicon as L
from ..operators import segment as S
from ..operators.ordered import suppress_in_order
from ..operators.select import best_k
from ..sources import dumps
from ..storage import materialise
from ..streaming import lexicons, pipe
from . import train as training

#: Least count of a seed word, and of an eligible word when pruning.
SEED, LEAST, TARGET = 200, 15, 300
CHAR_LEAST = 2000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts; a table that is read in fewer tasks than there are cores is dealt over all cores."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _han(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir)
    return rows.mapInArrow(spans.translated(dict(zip(T.LATIN, T.HANIFIED * 2, strict=True)), rows.columns), rows.schema)


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunk counts and the seed lexicon, kept for what reads them several times."""
    chunks = materialise(S.chunk_counts(_han(spark, sf_dir)))
    return chunks, materialise(L.seed_lexicon(S.runs_of(chunks), SEED))


def normalize_spaces(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize_spaces(F.concat(F.lit("  "), "text", F.lit("  "))).alias("text"))


def pretokenize_counts(spark, sf_dir):
    return S.chunk_counts(_documents(spark, sf_dir)).select("chunk", "n")


def token_kind_counts(spark, sf_dir):
    chunks = S.chunk_counts(_han(spark, sf_dir))
    return chunks.groupBy(T.token_kind(F.col("chunk")).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


def split_punct(spark, sf_dir):
    return S.punct_segments(_han(spark, sf_dir))


def split_han_runs(spark, sf_dir):
    parts = _han(spark, sf_dir).select(F.explode(T.split_script(F.col("text"))).alias("segment"))
    return parts.groupBy("segment").agg(F.count("*").alias("n")).withColumn("script", F.col("segment").rlike(rf"^{C.one(C.SCRIPT)}"))


def valid_word_count(spark, sf_dir):
    return S.recount(_documents(spark, sf_dir), line_col="text")


def clean_text(spark, sf_dir):
    marked = F.concat(F.lit("# Heading\n\n"), "text", F.lit("\n##  Part　two\n \t"), "text", F.lit(" \n"))
    return _documents(spark, sf_dir).select("doc_id", T.clean_text(marked).alias("text"))


def sentence_split(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", F.translate("text", ".!?", "。！？").alias("text"))
    return rows.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_no", "sentence")).withColumn("sent_no", F.col("sent_no").cast("bigint"))


def char_count(spark, sf_dir):
    return L.char_counts(_han(spark, sf_dir))


def seed_lexicon(spark, sf_dir):
    return L.seed_lexicon(S.runs_of(S.chunk_counts(_han(spark, sf_dir))), SEED)


def _seeds_and_chars(spark, sf_dir):
    """The seed lexicon and the counts of characters, kept: the texts are read once, for the chunk counts that both come from."""
    chunks, words = _model(spark, sf_dir)
    return words, materialise(L.char_counts_of(chunks))


def lexicon_char_filter(spark, sf_dir):
    return L.filter_by_chars(*_seeds_and_chars(spark, sf_dir), CHAR_LEAST)


def lexicon_add_singles(spark, sf_dir):
    words, counts = _seeds_and_chars(spark, sf_dir)
    return L.add_single_chars(L.filter_by_chars(words, counts, CHAR_LEAST), counts)


def _titles(spark, sf_dir):
    """The words between blanks, each once, but empty ones, which are no titles."""
    words = _documents(spark, sf_dir).select("text").mapInArrow(spans.words_between_blanks, "word string").distinct()
    return words.select(T.hanify(F.translate("word", ",.", "·")).alias("word"))


def lexicon_union_filter(spark, sf_dir):
    titles = _titles(spark, sf_dir)
    letters = F.regexp_extract_all(T.hanify(F.concat_ws(" ", "p_brand", "p_type")), F.lit(f"({C.one(C.HAN)}{{1,3}})"), F.lit(1))
    pairs = _table(spark, sf_dir, "part").select(F.explode(letters).alias("source")).withColumn("target", F.col("source"))
    return L.union_words(L.title_words(titles), L.pure_words(titles, 4), L.redirect_words(pairs), None)


def constituent_chars(spark, sf_dir):
    return L.with_constituents(lexicon_union_filter(spark, sf_dir))


def title_prefix_suppress(spark, sf_dir):
    return L.good_titles(_titles(spark, sf_dir), "word")


def titles_in_order(spark, sf_dir):
    """Beginnings of part types of several lengths, in an order in which some follow their own beginnings and others don't."""
    letters = F.regexp_replace(T.hanify(F.col("p_type")), C.none_of(C.HAN), "")
    title = F.substring(letters, F.lit(1), (F.pmod("p_partkey", F.lit(9)) + 3).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.struct("p_type", "p_size", "p_partkey").alias("line"))
    return suppress_in_order(rows).select("p_partkey", "title")


def lattice_edges(spark, sf_dir):
    chunks, lexicon = _model(spark, sf_dir)
    edges = S.lattice(S.runs_of(chunks), L.word_scores(lexicon), 4)
    return edges.select("chunk", F.col("pos").cast("bigint").alias("pos"), F.col("len").cast("bigint").alias("len"), F.round("lp", 6).alias("lp"))


def viterbi_cut(spark, sf_dir):
    chunks, lexicon = _model(spark, sf_dir)
    return S.cut_runs(S.runs_of(chunks), lexicon).select("chunk", F.array_join("tokens", " ").alias("tokens"))


def viterbi_cut_native(spark, sf_dir):
    chunks, lexicon = _model(spark, sf_dir)
    return S.cut_runs(S.runs_of(chunks), lexicon, engine="native").select("chunk", F.array_join("tokens", " ").alias("tokens"))


def cut_token_counts(spark, sf_dir):
    return S.token_counts(*_model(spark, sf_dir))


def cut_documents(spark, sf_dir):
    docs = _han(spark, sf_dir)
    return S.cut(docs, _model(spark, sf_dir)[1]).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def cut_documents_indexed(spark, sf_dir):
    docs = _han(spark, sf_dir)
    return S.cut(docs, _model(spark, sf_dir)[1], engine="index").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def segment_documents_indexed(spark, sf_dir):
    words = _model(spark, sf_dir)[1]
    return S.segment_longest_match(_han(spark, sf_dir), words, engine="index").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def longest_match_cut(spark, sf_dir):
    segments = S.punct_segments(_han(spark, sf_dir)).where("not delimiter")
    return S.match_segments(segments, materialise(seed_lexicon(spark, sf_dir))).select("chunk", F.array_join("tokens", " ").alias("tokens"))


def segment_documents(spark, sf_dir):
    return S.segment_longest_match(_han(spark, sf_dir), _model(spark, sf_dir)[1]).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def cold_start_counts(spark, sf_dir):
    return S.match_counts(_han(spark, sf_dir), _model(spark, sf_dir)[1])


def word_loss(spark, sf_dir):
    return S.word_loss(*_model(spark, sf_dir)).select("word", (F.round("loss", 4) + 0.0).alias("loss"), "cnt")


def prune_keep(spark, sf_dir):
    chunks, lexicon = _model(spark, sf_dir)
    return L.keep_by_loss(materialise(S.word_loss(chunks, lexicon)), lexicon, TARGET, LEAST)


def best_tokens(spark, sf_dir):
    """The best three quarters of the distinct pre-tokens by count over length; most scores are shared by many."""
    chunks = materialise(S.chunk_counts(_documents(spark, sf_dir)))
    return best_k(chunks, chunks.count() * 3 // 4, F.col("n") / F.char_length("chunk"), F.col("chunk")).select("chunk", "n")


def _reversing(spark, sf_dir):
    """A conversion table of the seed words of several characters, which turns them round."""
    words = _model(spark, sf_dir)[1].where(F.char_length("word") > 1)
    return words.select(F.col("word").alias("source"), F.reverse("word").alias("target"))


def convert_documents(spark, sf_dir):
    return convert.convert(_han(spark, sf_dir), "text", _reversing(spark, sf_dir))


def convert_documents_joined(spark, sf_dir):
    return convert.convert(_han(spark, sf_dir), "text", _reversing(spark, sf_dir), engine="join")


def _long_runs(spark, sf_dir):
    letters = F.regexp_replace(T.hanify(F.col("text")), C.none_of(C.HAN), "")
    return _table(spark, sf_dir, "benchmark").select(letters.alias("chunk")).where("chunk <> ''").distinct()


def cut_long_runs(spark, sf_dir):
    """The letters of every benchmark text as one run, cut with a joined lexicon."""
    return S.cut_runs(_long_runs(spark, sf_dir), _model(spark, sf_dir)[1], engine="native").select("chunk", F.array_join("tokens", " ").alias("tokens"))


def em_one_iteration(spark, sf_dir):
    return training.em_step(*_model(spark, sf_dir))


def em_train(spark, sf_dir):
    return training.train(_han(spark, sf_dir), materialise(seed_lexicon(spark, sf_dir)).select("word"), TARGET, 2, LEAST)


def _dumps(spark, sf_dir):
    """Orders as a redirect dump and customers as a page dump, one INSERT line each."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.col(c), F.lit(" "), F.lit("_")), F.lit("#"), F.lit("\\'")), F.lit("'"))
    pages = _table(spark, sf_dir, "customer").select(F.concat(F.lit("INSERT INTO `page` VALUES ("), "c_custkey", F.lit(","), F.pmod("c_custkey", F.lit(3)), F.lit(","), quoted("c_name"), F.lit(",0,'x,)y');")).alias("value"))
    redirects = _table(spark, sf_dir, "orders").select(F.concat(F.lit("INSERT INTO `redirect` VALUES ("), "o_custkey", F.lit(","), F.pmod("o_orderkey", F.lit(2)), F.lit(","), quoted("o_orderpriority"), F.lit(",'',''),(0,4,'no','','');")).alias("value"))
    return pages, redirects


def mysql_tuple_parse(spark, sf_dir):
    return dumps.insert_tuples(_dumps(spark, sf_dir)[0]).select(F.array_join("fields", "|").alias("fields"))


def mysql_tuple_split(spark, sf_dir):
    """The same pages in one INSERT line for each nation, read in pieces of 1,000 characters."""
    pages = _dumps(spark, sf_dir)[0].select(F.expr("substr(value, instr(value, 'VALUES ') + 7)").alias("tuple"), (F.xxhash64("value") % 25).alias("line"))
    lines = pages.groupBy("line").agg(F.concat(F.lit("INSERT INTO `page` VALUES "), F.array_join(F.transform(F.collect_list("tuple"), lambda t: F.rtrim(t, F.lit(";"))), ","), F.lit(";")).alias("value"))
    return dumps.insert_tuples(lines, size=1000).select(F.array_join("fields", "|").alias("fields"))


def redirect_join(spark, sf_dir):
    pages, redirects = map(dumps.insert_tuples, _dumps(spark, sf_dir))
    return dumps.redirect_pairs(dumps.pages(pages), dumps.redirects(redirects))


def wikitext_words(spark, sf_dir):
    """Every document as a page of list lines: by turns with a bold colon, without one, and no list line."""
    bold = lambda w: F.concat(F.lit("'''"), w, F.lit("'''"))

    def line(word, i):
        colon = F.concat(F.lit("* "), bold(F.concat(word, F.lit("/x(y)"))), F.lit("："), bold(F.lit("ab")), F.lit(" "), bold(word))
        return F.when(i % 3 == 0, colon).when(i % 3 == 1, F.concat(F.lit("* "), bold(word))).otherwise(F.concat(F.lit(" no "), bold(word)))

    listed = F.array_join(F.transform(F.filter(F.split("text", r"[\s'{}]+"), lambda w: w != ""), line), "\n")
    return dumps.list_words(_documents(spark, sf_dir).select(F.concat(F.lit("{{a|{{b}}}}\n"), listed).alias("source")))


def stream_cut(spark, sf_dir):
    """The benchmark texts as a stream of files, cut and written once, then read again."""
    import uuid

    from ..storage import shared_folder

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lexicon = _model(spark, sf_dir)[1]
    source = spark.readStream.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark*.parquet")
    lines = source.select("item_id", T.hanify(F.col("text")).alias("value"))
    cut = pipe.cut_stream(lines, lexicon).select("item_id", F.array_join("tokens", " ").alias("tokens"))
    cut.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("item_id bigint, tokens string").parquet(f"{folder}/out")


def stream_cut_joined(spark, sf_dir):
    """The same stream cut batch by batch with the published version of the lexicon, which is joined as one over the limit is."""
    import uuid

    from ..storage import shared_folder

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    lexicons.publish(_model(spark, sf_dir)[1], f"{folder}/lexicon")
    source = spark.readStream.schema("item_id bigint, text string").parquet(f"{sf_dir}/benchmark*.parquet")
    lines = source.select("item_id", T.hanify(F.col("text")).alias("value"))
    lexicons.cut_batches(lines, f"{folder}/lexicon", f"{folder}/out", f"{folder}/log", engine="native").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("item_id bigint, tokens array<string>").parquet(f"{folder}/out/batch=*").select("item_id", F.array_join("tokens", " ").alias("tokens"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        normalize_spaces, pretokenize_counts, token_kind_counts, split_punct, split_han_runs, valid_word_count, clean_text, sentence_split, char_count, seed_lexicon,
        lexicon_char_filter, lexicon_add_singles, lexicon_union_filter, constituent_chars, title_prefix_suppress, titles_in_order, lattice_edges, viterbi_cut, viterbi_cut_native, cut_token_counts,
        cut_documents, cut_documents_indexed, segment_documents_indexed, longest_match_cut, segment_documents, cold_start_counts, word_loss, prune_keep, best_tokens, convert_documents, convert_documents_joined, cut_long_runs, em_one_iteration, em_train, mysql_tuple_parse, mysql_tuple_split, redirect_join, wikitext_words, stream_cut, stream_cut_joined,
    )
    return {f.__name__: f for f in every}


# SQL counterparts, built from shared common table expressions


def _norm(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({text}, '^ +', ''), ' +', '{C.SPACE_MARK}', 'g'), '{C.SPACE_MARK}\\z', '')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


HAN_SQL = f"translate(text, '{T.LATIN}', '{T.HANIFIED * 2}')"


def _pure(word: str) -> str:
    return f"regexp_full_match({word}, '{C.one(C.PURE)}+')"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '{C.STRIP}', '', 'g')"




def _chunks(text: str) -> str:
    return f"c0 AS (SELECT unnest(regexp_extract_all({_norm(text)}, {_quoted(C.PRETOKEN)}, 1)) AS chunk FROM documents), chunks AS (SELECT chunk, count(*) AS n, regexp_matches(chunk, '^{C.one(C.HAN)}') AS han FROM c0 GROUP BY chunk)"


RUNS = f"{_chunks(HAN_SQL)}, runs AS (SELECT chunk, n FROM chunks WHERE han)"
LEXICON = f"""{RUNS},
lex AS (SELECT substr(chunk, i, k) AS word, sum(n)::BIGINT AS freq FROM runs, unnest(range(1, length(chunk) + 1)) AS a(i), unnest(range(1, 5)) AS b(k)
        WHERE i + k - 1 <= length(chunk) GROUP BY 1 HAVING sum(n) >= {SEED} OR length(word) = 1)"""
EDGES = f"""{LEXICON},
tot AS (SELECT sum(freq)::DOUBLE AS total FROM lex),
scored AS (SELECT word, ln(greatest(freq, 1) / total) AS lp FROM lex, tot),
edges AS (SELECT chunk, i AS pos, k AS len, coalesce(lp, ln(1 / total)) AS lp
          FROM runs CROSS JOIN unnest(range(1, length(chunk) + 1)) AS a(i) CROSS JOIN unnest(range(1, 5)) AS b(k) CROSS JOIN tot LEFT JOIN scored ON word = substr(chunk, i, k)
          WHERE i + k - 1 <= length(chunk) AND (lp IS NOT NULL OR k = 1))"""
BEST = f"""{EDGES},
bw(chunk, p, s, nx) AS (
  SELECT chunk, length(chunk) + 1, [1.0::DOUBLE], []::BIGINT[] FROM runs
  UNION ALL
  SELECT b.chunk, b.p - 1, list_prepend(max(e.lp + b.s[e.len]), any_value(b.s)), list_prepend(arg_max(e.len, (e.lp + b.s[e.len], -e.len)), any_value(b.nx))
  FROM bw b JOIN edges e ON e.chunk = b.chunk AND e.pos = b.p - 1 GROUP BY b.chunk, b.p),
best AS (SELECT chunk, s, nx FROM bw WHERE p = 1)"""
PATH = """path(chunk, nx, place, len) AS (
  SELECT chunk, nx, 1::BIGINT, nx[1] FROM best
  UNION ALL
  SELECT chunk, nx, place + len, nx[place + len] FROM path WHERE place + len <= length(chunk))"""
BACK = f"""{BEST},
walk(chunk, nx, place, tokens) AS (
  SELECT chunk, nx, 1::BIGINT, []::VARCHAR[] FROM best
  UNION ALL
  SELECT chunk, nx, place + nx[place], list_append(tokens, substr(chunk, place, nx[place])) FROM walk WHERE place <= length(chunk)),
cuts AS (SELECT chunk, tokens FROM walk WHERE place > length(chunk))"""
COUNTED = f"""{BEST}, {PATH},
counted AS (SELECT word, sum(n)::BIGINT AS freq FROM (SELECT substr(chunk, place, len) AS word, n FROM path JOIN runs USING (chunk) UNION ALL SELECT chunk, n FROM chunks WHERE NOT han) WHERE regexp_matches(word, '[^ \\t\\n\\r]') GROUP BY word)"""
LOSS = f"""{BEST}, {PATH},
fw(chunk, p, f) AS (
  SELECT chunk, 1::BIGINT, [0.0::DOUBLE] FROM runs
  UNION ALL
  SELECT b.chunk, b.p + 1, list_append(any_value(b.f), max(b.f[e.pos] + e.lp)) FROM fw b JOIN edges e ON e.chunk = b.chunk AND e.pos + e.len = b.p + 1 GROUP BY b.chunk, b.p),
ends AS (SELECT chunk, f FROM fw WHERE p = length(chunk) + 1),
alt AS (SELECT q.chunk, q.place, q.len, max(f[e.pos] + e.lp + s[e.pos + e.len]) AS other
        FROM path q JOIN edges e ON e.chunk = q.chunk AND e.pos <= q.place AND q.place < e.pos + e.len AND NOT (e.pos = q.place AND e.len = q.len) JOIN best ON best.chunk = q.chunk JOIN ends ON ends.chunk = q.chunk
        WHERE q.len > 1 GROUP BY ALL),
lost AS (SELECT substr(q.chunk, q.place, q.len) AS word, CASE WHEN q.len = 1 THEN e.lp - ln(1 / total) ELSE best.s[1] - alt.other END AS loss, n
         FROM path q JOIN runs ON runs.chunk = q.chunk JOIN best ON best.chunk = q.chunk JOIN tot ON true JOIN edges e ON e.chunk = q.chunk AND e.pos = q.place AND e.len = q.len LEFT JOIN alt ON alt.chunk = q.chunk AND alt.place = q.place),
losses AS (SELECT word, coalesce(sum(n * loss), 0) AS loss, coalesce(sum(n), 0)::BIGINT AS cnt FROM lex LEFT JOIN lost USING (word) GROUP BY word)"""
#: The tables of one step of training, and those of them that are read more than once.
STEP, STEP_KEPT = "lex|runs|tot|scored|edges|bw|best|path|counted|fw|ends|alt|lost|losses", "tot|edges|best|ends|alt"
#: Rounds of training in the SQL; rounds behind the one that reaches TARGET change nothing.
ROUNDS = 10
SEGMENTS = f"segs AS (SELECT chunk, count(*) AS n, regexp_matches(chunk, '^{C.one(C.PUNCT)}') AS delimiter FROM (SELECT unnest(regexp_extract_all({HAN_SQL}, {_quoted(C.PUNCT_SPLIT)}, 1)) AS chunk FROM documents) GROUP BY chunk)"
MATCHED = f"""{LEXICON}, {SEGMENTS},
longest AS (SELECT chunk, i, max(CASE WHEN word IS NULL THEN 1 ELSE k END) AS len
            FROM segs CROSS JOIN unnest(range(1, length(chunk) + 1)) AS a(i) CROSS JOIN unnest(range(1, 5)) AS b(k) LEFT JOIN lex ON word = substr(chunk, i, k) AND i + k - 1 <= length(chunk)
            WHERE NOT delimiter GROUP BY chunk, i),
steps AS (SELECT chunk, list(len ORDER BY i) AS nx FROM longest GROUP BY chunk),
mwalk(chunk, nx, place, tokens) AS (
  SELECT chunk, nx, 1::BIGINT, []::VARCHAR[] FROM steps
  UNION ALL
  SELECT chunk, nx, place + nx[place], list_append(tokens, substr(chunk, place, nx[place])) FROM mwalk WHERE place <= length(chunk)),
matches AS (SELECT chunk, tokens FROM mwalk WHERE place > length(chunk))"""
CHARS = f"chars AS (SELECT ch, count(*) AS cnt FROM (SELECT unnest(string_split({HAN_SQL}, '')) AS ch FROM documents) WHERE {_pure('ch')} GROUP BY ch)"
FILTERED = f"{LEXICON}, {CHARS}, rare AS (SELECT DISTINCT word FROM (SELECT word, unnest(string_split(word, '')) AS ch FROM lex) LEFT JOIN chars USING (ch) WHERE coalesce(cnt, 0) < {CHAR_LEAST}), kept AS (SELECT word FROM lex ANTI JOIN rare USING (word))"
TITLES = f"titles AS (SELECT unnest(regexp_split_to_array(translate(translate(text, ',.', '·'), '{T.LATIN}', '{T.HANIFIED * 2}'), '[ \\n]+')) AS word FROM documents)"
UNION = f"""{TITLES},
parts AS (SELECT unnest(string_split(word, '·')) AS part, contains(word, '·') AS dotted FROM titles),
sides AS (SELECT translate(unnest(regexp_extract_all(p_brand || ' ' || p_type, '([A-Za-z]{{1,3}})', 1)), '{T.LATIN}', '{T.HANIFIED * 2}') AS word FROM part),
united AS (SELECT part AS word FROM parts WHERE {_pure("part")} AND length(part) <= CASE WHEN dotted THEN 4 ELSE 3 END
           UNION SELECT word FROM titles WHERE {_pure("word")} AND length(word) <= 4 UNION SELECT word FROM sides WHERE {_pure("word")} AND length(word) <= 3)"""
CLEAN = "'# Heading' || chr(10) || chr(10) || text || chr(10) || '##  Part' || chr(12288) || 'two' || chr(10) || ' ' || chr(9) || text || chr(160) || chr(10)"
MYSQL_PAGES = "SELECT c_custkey || '|' || c_custkey % 3 || '|' || replace(replace(c_name, ' ', '_'), '#', '\\''') || '|0|x,)y' AS fields FROM customer"
PAGE_NAME = "replace(c_name, '#', '''')"


def _cut_rows(table: str, key: str) -> str:
    """The rows of a table cut with the lexicon of documents; runs that documents don't have are cut too."""
    both = BACK.replace("runs AS (SELECT chunk, n FROM chunks WHERE han)", f"""other AS (SELECT DISTINCT unnest(regexp_extract_all({_norm(HAN_SQL)}, {_quoted(C.PRETOKEN)}, 1)) AS chunk FROM {table}),
all_runs AS (SELECT chunk, n FROM chunks WHERE han), runs AS (SELECT chunk, n FROM all_runs UNION ALL SELECT chunk, 0 FROM other ANTI JOIN all_runs USING (chunk) WHERE regexp_matches(chunk, '^{C.one(C.HAN)}'))""")
    both = both.replace("AS freq FROM runs, unnest", "AS freq FROM all_runs, unnest")
    return f"WITH RECURSIVE {both}, d AS (SELECT {key}, i, l[i] AS chunk FROM (SELECT {key}, regexp_extract_all({_norm(HAN_SQL)}, {_quoted(C.PRETOKEN)}, 1) AS l FROM {table}), unnest(range(1, len(l) + 1)) AS u(i)) SELECT {key}, string_agg(coalesce(array_to_string(tokens, ' '), chunk), ' ' ORDER BY i) AS tokens FROM d LEFT JOIN cuts USING (chunk) GROUP BY {key}"


def _long_runs_sql() -> str:
    runs = f"SELECT DISTINCT regexp_replace({HAN_SQL}, '{C.none_of(C.HAN)}', '', 'g') AS chunk, 1 AS n FROM benchmark"
    return BACK.replace("runs AS (SELECT chunk, n FROM chunks WHERE han)", f"all_runs AS (SELECT chunk, n FROM chunks WHERE han), runs AS (SELECT * FROM ({runs}) WHERE chunk <> '')").replace("AS freq FROM runs, unnest", "AS freq FROM all_runs, unnest")


def _train_sql(rounds: int = ROUNDS) -> str:
    """Rounds of training one behind the other: the tables of step n have n in their names, and lex_n is the lexicon it starts from."""
    start = "SELECT word, sum(n)::BIGINT AS freq FROM (SELECT unnest(tokens) AS word, n FROM matches JOIN segs USING (chunk) UNION ALL SELECT chunk, n FROM segs WHERE delimiter) WHERE word IN (SELECT word FROM lex) GROUP BY word"
    estimate = (COUNTED, "SELECT word, freq FROM counted WHERE word IN (SELECT word FROM lex)")
    prune = (LOSS, f"""SELECT lex.* FROM lex WHERE length(word) = 1 OR word IN (
        SELECT word FROM (SELECT word, row_number() OVER (ORDER BY loss / sqrt(cnt) / length(word) DESC, word DESC) AS r, count(*) OVER () AS size FROM losses WHERE length(word) > 1 AND cnt >= {LEAST})
        WHERE r <= greatest({TARGET} - (SELECT count(*) FROM lex WHERE length(word) = 1), size * 75 // 100))""")
    steps = [(step, 3 * k) for k in range(rounds) for step in (estimate, estimate, prune)] + [(estimate, None)] * 2
    tables = [f"lex_0 AS MATERIALIZED ({start})"]
    for n, ((own, result), first) in enumerate(steps):
        goes_on = "true" if first is None else f"(SELECT count(*) FROM lex_{first}) > {TARGET}"
        numbered = lambda sql, n=n: re.sub(rf"(?<![\w.'])({STEP})\b", rf"\1_{n}", sql)
        own = re.sub(rf"\b((?:{STEP_KEPT})_{n}) AS \(", r"\1 AS MATERIALIZED (", numbered(own.removeprefix(LEXICON)))
        tables.append(f"go_{n} AS MATERIALIZED (SELECT {goes_on} AS go), runs_{n} AS MATERIALIZED (SELECT runs.* FROM runs, go_{n} WHERE go){own}")
        tables.append(f"lex_{n + 1} AS MATERIALIZED (SELECT word, freq FROM ({numbered(result)}), go_{n} WHERE go UNION ALL SELECT word, freq FROM lex_{n}, go_{n} WHERE NOT go)")
    return f"WITH RECURSIVE {MATCHED}, {', '.join(tables)} SELECT word, freq FROM lex_{len(steps)}"


def oracle_sql() -> dict[str, str]:
    segmented = f"WITH RECURSIVE {MATCHED}, d AS (SELECT doc_id, i, l[i] AS chunk FROM (SELECT doc_id, regexp_extract_all({HAN_SQL}, {_quoted(C.PUNCT_SPLIT)}, 1) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
    turned = f"{segmented}, t AS (SELECT doc_id, string_agg(coalesce(array_to_string(list_transform(tokens, lambda w: reverse(w)), ''), chunk), '' ORDER BY i) AS text FROM d LEFT JOIN matches USING (chunk) GROUP BY doc_id) SELECT doc_id, coalesce(t.text, documents.text) AS text FROM documents LEFT JOIN t USING (doc_id)"
    sentences = f"list_filter(list_transform(regexp_extract_all(translate(text, '.!?', '。！？'), '{C.SENTENCE}'), lambda s: {_strip('s')}), lambda s: s <> '')"
    return {
        "normalize_spaces": f"SELECT doc_id, {_norm("('  ' || text || '  ')")} AS text FROM documents",
        "pretokenize_counts": f"WITH {_chunks('text')} SELECT chunk, n FROM chunks",
        "token_kind_counts": f"WITH {_chunks(HAN_SQL)} SELECT CASE WHEN starts_with(chunk, '{C.SPACE_MARK}') THEN 'space' WHEN han THEN 'han' WHEN regexp_matches(chunk, '^{C.one(C.DIGIT)}') THEN 'digit' WHEN regexp_matches(chunk, '^{C.one(C.LETTER)}') THEN 'letter' ELSE 'punct' END AS kind, sum(n)::BIGINT AS n, count(*) AS n_distinct FROM chunks GROUP BY 1",
        "split_punct": f"WITH {SEGMENTS} SELECT chunk, n, delimiter FROM segs",
        "split_han_runs": f"SELECT segment, count(*) AS n, regexp_matches(segment, '^{C.one(C.SCRIPT)}') AS script FROM (SELECT unnest(regexp_extract_all({HAN_SQL}, {_quoted(C.SCRIPT_SPLIT)}, 1)) AS segment FROM documents) GROUP BY segment",
        "valid_word_count": "SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_matches(word, '[^ \\t\\n\\r]') GROUP BY word",
        "clean_text": f"SELECT doc_id, regexp_replace({_strip(f"regexp_replace({CLEAN}, '(?m){C.HEADING}', '', 'g')")}, '{C.one(C.BLANK)}+', ' ', 'g') AS text FROM documents",
        "sentence_split": f"SELECT doc_id, i - 1 AS sent_no, s[i] AS sentence FROM (SELECT doc_id, {sentences} AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)",
        "char_count": f"WITH {CHARS} SELECT ch, cnt FROM chars",
        "seed_lexicon": f"WITH {LEXICON} SELECT word, freq FROM lex",
        "lexicon_char_filter": f"WITH {FILTERED} SELECT word FROM kept",
        "lexicon_add_singles": f"WITH {FILTERED} SELECT word FROM kept UNION SELECT ch FROM chars WHERE ch BETWEEN '一' AND chr(40959)",
        "lexicon_union_filter": f"WITH {UNION} SELECT word FROM united",
        "constituent_chars": f"WITH {UNION} SELECT word FROM united UNION SELECT unnest(string_split(word, '')) FROM united WHERE length(word) > 1",
        "title_prefix_suppress": f"WITH {TITLES}, good AS (SELECT DISTINCT word AS title FROM titles WHERE regexp_full_match(word, '(?:{C.one(C.TITLE)}{C.one(C.VARIATION)}?)+') AND length(word) >= 2 AND NOT ends_with(word, '列表') AND NOT ends_with(word, '对照表')) SELECT title FROM good a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT g.title AS t FROM good g, unnest(range(4, length(g.title))) AS u(k) JOIN good p ON p.title = substr(g.title, 1, k)) x WHERE x.t = a.title)",
        "titles_in_order": f"""WITH RECURSIVE numbered AS (
            SELECT p_partkey, substr(regexp_replace(translate(p_type, '{T.LATIN}', '{T.HANIFIED * 2}'), '{C.none_of(C.HAN)}', '', 'g'), 1, (p_partkey % 9 + 3)::INT) AS title, row_number() OVER (ORDER BY p_type, p_size, p_partkey) AS i FROM part),
            listed AS (SELECT list(title ORDER BY i) AS titles FROM numbered),
            fold(i, before, stays) AS (
              SELECT 0::BIGINT, ''::VARCHAR, false
              UNION ALL
              SELECT i + 1, CASE WHEN length(before) >= 4 AND starts_with(titles[i + 1], before) THEN before ELSE titles[i + 1] END, NOT (length(before) >= 4 AND starts_with(titles[i + 1], before)) FROM fold, listed WHERE i < len(titles))
            SELECT p_partkey, title FROM numbered JOIN fold USING (i) WHERE stays""",
        "lattice_edges": f"WITH {EDGES} SELECT chunk, pos, len, round(lp, 6) AS lp FROM edges",
        "viterbi_cut": f"WITH RECURSIVE {BACK} SELECT chunk, array_to_string(tokens, ' ') AS tokens FROM cuts",
        "viterbi_cut_native": f"WITH RECURSIVE {BACK} SELECT chunk, array_to_string(tokens, ' ') AS tokens FROM cuts",
        "cut_token_counts": f"WITH RECURSIVE {COUNTED} SELECT word, freq FROM counted",
        **dict.fromkeys(("cut_documents", "cut_documents_indexed"), _cut_rows("documents", "doc_id")),
        "stream_cut": _cut_rows("benchmark", "item_id"),
        "stream_cut_joined": _cut_rows("benchmark", "item_id"),
        **dict.fromkeys(("segment_documents", "segment_documents_indexed"), f"{segmented} SELECT doc_id, string_agg(coalesce(array_to_string(tokens, ' '), chunk), ' ' ORDER BY i) AS tokens FROM d LEFT JOIN matches USING (chunk) GROUP BY doc_id"),
        "longest_match_cut": f"WITH RECURSIVE {MATCHED} SELECT chunk, array_to_string(tokens, ' ') AS tokens FROM matches",
        "cold_start_counts": f"WITH RECURSIVE {MATCHED} SELECT word, sum(n)::BIGINT AS freq FROM (SELECT unnest(tokens) AS word, n FROM matches JOIN segs USING (chunk) UNION ALL SELECT chunk, n FROM segs WHERE delimiter) WHERE word IN (SELECT word FROM lex) GROUP BY word",
        "word_loss": f"WITH RECURSIVE {LOSS} SELECT word, round(loss, 4) + 0.0 AS loss, cnt FROM losses",
        "prune_keep": f"WITH RECURSIVE {LOSS}, el AS (SELECT word, loss / sqrt(cnt) / length(word) AS score FROM losses WHERE length(word) > 1 AND cnt >= {LEAST}), k AS (SELECT greatest({TARGET} - (SELECT count(*) FROM lex WHERE length(word) = 1), (SELECT count(*) FROM el) * 75 // 100) AS size) SELECT word FROM lex WHERE length(word) = 1 UNION ALL SELECT word FROM (SELECT word, row_number() OVER (ORDER BY score DESC, word DESC) AS r FROM el), k WHERE r <= size",
        "best_tokens": f"WITH {_chunks('text')} SELECT chunk, n FROM (SELECT chunk, n, row_number() OVER (ORDER BY n / length(chunk) DESC, chunk DESC) AS r, count(*) OVER () AS size FROM chunks) WHERE r <= size * 3 // 4",
        "convert_documents": turned,
        "convert_documents_joined": turned,
        "cut_long_runs": f"WITH RECURSIVE {_long_runs_sql()} SELECT chunk, array_to_string(tokens, ' ') AS tokens FROM cuts",
        "em_one_iteration": f"WITH RECURSIVE {COUNTED} SELECT word, freq FROM counted WHERE word IN (SELECT word FROM lex)",
        "em_train": _train_sql(),
        "mysql_tuple_parse": MYSQL_PAGES,
        "mysql_tuple_split": MYSQL_PAGES,
        "redirect_join": f"SELECT {PAGE_NAME} AS source, target FROM customer JOIN (SELECT o_custkey, max(o_orderpriority) AS target FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 3 = 0",
        "wikitext_words": f"""SELECT DISTINCT {_strip(_garbage('w'))} AS word FROM (SELECT {_strip('unnest(regexp_split_to_array(b, ' + _quoted(dumps.SEPARATORS) + '))')} AS w FROM (
            SELECT unnest(CASE i % 3 WHEN 0 THEN list_filter([word || '/x(y)', CASE WHEN length(word) > 2 THEN word END], lambda b: b IS NOT NULL) WHEN 1 THEN [word] ELSE []::VARCHAR[] END) AS b
            FROM (SELECT l[i + 1] AS word, i FROM (SELECT list_filter(regexp_split_to_array(text, '[\\s''{{}}]+'), lambda w: w <> '') AS l FROM documents), unnest(range(0, len(l))) AS u(i))))""",
    }


def _garbage(word: str) -> str:
    for g in dumps.GARBAGE:
        word = f"replace({word}, '{g}', '')"
    return word
