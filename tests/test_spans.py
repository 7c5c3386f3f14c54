"""Splitting in Arrow tasks against the same split by regular expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import convert, spans
from lexiloom.functions import text as T
from lexiloom.operators import lexicon as L
from lexiloom.operators import segment as S
from lexiloom.sources import dumps

ALPHABET = " ' ▁ab的一12Ａ９ﾞ。，\n\té̀𠀀😀\U000323af　'"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = ["", " ", "  ", "▁", " ▁", "▁ ", "▁▁", "a'b'c''d'", "'a", "a'", "的'的", " a  b ", "a▁", None]
    rows += ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    broken = spark.sql("select -1L as doc_id, cast(unhex('61FF62E4B820C0') as string) as text")
    return df.unionByName(broken).repartition(3).cache()


@pytest.mark.parametrize("part", [8, 1 << 19])
def test_pieces_are_those_of_the_expressions(spark, texts, part, monkeypatch):
    monkeypatch.setattr(spans, "PART", part)
    chunks = texts.select(F.explode(T.pretokenize(T.normalize_spaces(F.col("text")))).alias("chunk"))
    assert sorted(S.chunk_counts(texts).select("chunk", "n").collect()) == sorted(chunks.groupBy("chunk").count().collect())
    segments = texts.select(F.explode(T.split_punct(F.col("text"))).alias("chunk"))
    assert sorted(S.punct_segments(texts).select("chunk", "n").collect()) == sorted(segments.groupBy("chunk").count().collect())
    letters = texts.select(F.explode(T.split_chars(F.col("text"))).alias("ch")).where(T.is_pure(F.col("ch")))
    assert sorted(L.char_counts(texts).collect()) == sorted(letters.groupBy("ch").count().collect())


def test_rows_keep_their_own_pieces(spark, texts):
    words = spark.createDataFrame([("的一", 3), ("的", 1), ("ab", 1)], "word string, freq bigint")
    for cut in (S.cut, S.segment_longest_match):
        row_wise, joined = ({r.doc_id: r.tokens for r in cut(texts, words, engine=e).collect()} for e in ("auto", "native"))
        assert row_wise == joined


def test_scores_are_the_c_librarys(spark):
    words = spark.range(1, 3001).select(F.col("id").cast("string").alias("word"), F.col("id").alias("freq"))
    total = 3000 * 3001 / 2
    rows = L.word_scores(words).collect()
    assert all(r.lp == math.log(int(r.word) / total) and r.unknown == math.log(1 / total) for r in rows)


def test_long_runs_round_like_short_ones(spark):
    """Equal paths over a run of any length: which is taken depends on how the sums over the whole run round."""
    rng = random.Random(3)
    runs = ["".join(rng.choices("的一是", k=n)) for n in (300, 700, 2000)]
    words = spark.createDataFrame([("的", 7), ("一", 5), ("是", 11), ("的的", 3), ("一一", 2), ("的是", 3)], "word string, freq bigint")
    df = spark.createDataFrame([(r,) for r in runs], "chunk string")
    arrow, native = ({r.chunk: r.tokens for r in S.cut_runs(df, words, engine=e).collect()} for e in ("auto", "native"))
    assert arrow == native


@pytest.mark.parametrize("part", [8, 1 << 19])
def test_substrings_and_translation(spark, texts, part, monkeypatch):
    monkeypatch.setattr(spans, "PART", part)
    valid = texts.where("doc_id >= 0").withColumn("n", F.col("doc_id") % 5 + 1)
    wanted = {}
    for r in valid.where("text is not null").collect():
        for i in range(len(r.text)):
            for k in range(1, min(5, len(r.text) - i) + 1):
                wanted[r.text[i : i + k]] = wanted.get(r.text[i : i + k], 0) + r.n
    got = L.seed_lexicon(valid.select(F.coalesce("text", F.lit("")).alias("chunk"), "n"), 1, 5).collect()
    assert {r.word: r.freq for r in got} == wanted and len(got) == len(wanted)
    turned = valid.select("doc_id", "text").mapInArrow(spans.translated(dict(zip(T.LATIN, T.HANIFIED * 2)), ["doc_id", "text"]), "doc_id bigint, text string")
    assert {r[0]: r[1] for r in turned.collect()} == {r[0]: r[1] for r in valid.select("doc_id", T.hanify(F.col("text"))).collect()}


def test_conversion_of_pieces(spark, monkeypatch):
    """Small groups and parts; entries of letters that texts have between others, of longer and of no letters."""
    monkeypatch.setattr(spans, "PART", 16)
    monkeypatch.setattr(convert, "GROUP", 64)
    rng = random.Random(9)
    entries = {"".join(rng.choices("abc '𠀀", k=rng.randrange(1, 5))): rng.choice(["", "x", "éé", "b𠀀c", "longer than it"]) for _ in range(40)}
    rows = [None, "", "zz"] + ["".join(rng.choices("abcdez '𠀀é", k=rng.randrange(60))) for _ in range(400)]
    one = convert.Automaton(entries)
    wanted = sorted((i % 7, one.convert(r) if r is not None else None) for i, r in enumerate(rows) if r is not None)
    df = spark.createDataFrame([(i % 7, r, "kept") for i, r in enumerate(rows)], "id int, text string, `a.b` string").repartition(3)
    table = spark.createDataFrame(list(entries.items()), "source string, target string")
    for engine in ("auto", "join"):
        got = convert.convert(df, "text", table, engine=engine).collect()
        assert sorted((r[0], r[1]) for r in got if r[1] is not None) == wanted and len(got) == len(rows)
        assert all(r["a.b"] == "kept" for r in got)


def test_only_braces_of_templates_go_to_python(spark):
    """The Python step gets the marks alone, so its memory doesn't follow the pages' text."""
    rows = ["a{{b{{c}}d}}e{{f}}", "{{}}", "{{{x}}}y", "no marks", "", None, "é{{𠀀}}\n{{b}}的"]
    df = spark.createDataFrame([(r,) for r in rows], "source string").repartition(1)
    trimmed = df.select("source", dumps.trim_templates(F.col("source")).alias("t"))
    assert {r.source: r.t for r in trimmed.collect()} == {r: r and dumps.without_templates(r) for r in rows}
    plan = df.select(dumps.trim_templates(F.col("source")))._jdf.queryExecution().optimizedPlan().toString()
    udf = plan[plan.index("outside(") :]
    assert udf.startswith("outside(array_join(regexp_extract_all(")


def test_title_words_are_those_between_blanks(spark, texts):
    got = texts.select(F.make_valid_utf8("text").alias("text")).mapInArrow(spans.words_between_blanks, "word string").distinct()
    wanted = texts.select(F.explode(F.split(F.make_valid_utf8("text"), "[ \n]+")).alias("word")).where("word <> ''").distinct()
    assert sorted(got.collect()) == sorted(wanted.collect())
