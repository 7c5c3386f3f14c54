"""Goldens, properties and cross-checks of the segmenter."""

import math
import random
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.api import Cutter
from lexiloom.functions import text as T
from lexiloom.functions.convert import phrase_converter
from lexiloom.operators import kernels
from lexiloom.operators import lexicon as L
from lexiloom.operators import segment as S
from lexiloom.plans.train import train
from lexiloom.sources import dumps

G1 = [("南京", 100), ("南京市", 80), ("市长", 50), ("长江", 90), ("大桥", 60), ("江大桥", 30), ("长江大桥", 120)]
G3 = [("他", 50), ("是", 40), ("英国", 80), ("英国人", 100), ("人", 30)]


def frame(spark, words):
    return spark.createDataFrame(words, "word string, freq long")


def cuts(spark, words, texts, engine="auto"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in S.cut(docs, frame(spark, words), engine=engine).collect()}
    return [got[k] for k in range(len(texts))]


@pytest.mark.parametrize("engine", ["auto", "native"])
def test_rows_with_one_id_keep_apart(spark, engine):
    docs = spark.createDataFrame([(1, "甲乙丙 ab"), (1, "丙，甲"), (1, "丙，甲"), (None, "甲乙"), (2, None)], "doc_id long, text string")
    lexicon = frame(spark, [("甲乙", 9), ("甲", 1), ("丙", 1)])
    order = lambda rows: sorted([(r.doc_id, list(r.tokens)) for r in rows], key=repr)
    expected = [(1, ["甲乙", "丙", "▁", "ab"]), (1, ["丙", "，", "甲"]), (1, ["丙", "，", "甲"]), (None, ["甲乙"]), (2, [])]
    assert order(S.cut(docs, lexicon, engine=engine).collect()) == sorted(expected, key=repr)
    expected[0] = (1, ["甲乙", "丙", " ", "a", "b"])
    assert order(S.segment_longest_match(docs, lexicon, engine=engine).collect()) == sorted(expected, key=repr)


def test_losses_of_a_joined_lexicon(spark):
    rng = random.Random(4)
    words = [("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 4))), rng.randint(0, 50)) for _ in range(50)]
    chunks = spark.createDataFrame([("".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, 12))), k + 1, True) for k in range(40)], "chunk string, n long, han boolean")
    one, two = ({r.word: (round(r.loss, 9), r.cnt) for r in S.word_loss(chunks, frame(spark, words), engine=e).collect()} for e in ("auto", "join"))
    assert one == two and len(one) > 30


def test_a_lexicon_too_large_for_a_cutter_raises(spark, monkeypatch):
    monkeypatch.setattr(S.Model.__init__, "__defaults__", (1,))
    monkeypatch.setattr(S.index, "INDEX_WORDS", 1)
    with pytest.raises(ValueError, match="up to"):
        Cutter(spark, frame(spark, G1))


@pytest.mark.parametrize("engine", ["auto", "native"])
def test_goldens(spark, engine):
    assert cuts(spark, G1, ["南京市长江大桥"], engine) == [["南京市", "长江大桥"]]
    assert cuts(spark, [], ["你好世界"], engine) == [["你", "好", "世", "界"]]
    assert cuts(spark, G3, ["他是英国人Tom"], engine) == [["他", "是", "英国人", "Tom"]]
    assert cuts(spark, [("你好", 50), ("世界", 50)], ["你好，世界！", "", "   ", None], engine) == [["你好", "，", "世界", "！"], [], [], []]


def test_pretokens(spark):
    cases = {
        "  a  b ": "a|▁|b",
        "don't they'll a''b 3.14 abc123": "don't|▁|they'll|▁|a|'|'|b|▁|3|.|14|▁|abc|123",
        "▁x▁ ": "▁|x|▁",
        "'a b'": "'|a|▁|b|'",
        "a\n\tb": "a|\n|\t|b",
        "〇々𠀀㐀䷀é×÷": "〇|々|𠀀㐀|䷀é|×|÷",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    for r in df.select("text", T.pretokenize(T.normalize_spaces(F.col("text"))).alias("t")).collect():
        assert r.t == cases[r.text].split("|")


def test_scores(spark):
    rows = {r.word: r for r in L.word_scores(frame(spark, [("甲", 3), ("甲", 5), ("乙", 0), ("丙", 1), ("", 4)])).collect()}
    assert set(rows) == {"甲", "乙", "丙"}
    assert rows["甲"].lp == pytest.approx(math.log(5 / 9)) and rows["乙"].lp == rows["丙"].lp == pytest.approx(rows["甲"].unknown)
    with pytest.raises(Exception, match="negative"):
        L.word_scores(frame(spark, [("甲", -1)])).collect()
    assert cuts(spark, [("甲乙", 0)], ["甲乙"]) == [["甲", "乙"]]


def test_ties_take_the_shorter_word_first():
    scores = {"甲": -1.0, "乙": -1.0, "丙": -1.0, "甲乙": -2.0, "乙丙": -2.0}
    assert kernels.best_path("甲乙丙", scores, -9.0, 2) == ["甲", "乙", "丙"]


def all_paths(run, scores, unknown, longest, gone=None):
    def ways(at):
        if at == len(run):
            yield 1.0, []
            return
        for k in range(1, min(longest, len(run) - at) + 1):
            own = scores.get(run[at : at + k], unknown if k == 1 else None)
            if own is not None and (at, k) != gone:
                for rest, words in ways(at + k):
                    yield own + rest, [run[at : at + k], *words]

    return ways(0)


@settings(max_examples=80, deadline=None)
@given(st.text("甲乙丙", min_size=1, max_size=7), st.dictionaries(st.text("甲乙丙", min_size=1, max_size=3), st.integers(1, 40)))
def test_paths_and_losses_against_all_paths(run, freq):
    total = sum(freq.values()) or 1
    scores = {w: math.log(f / total) for w, f in freq.items()}
    unknown = math.log(1 / total)
    best = max(s for s, _ in all_paths(run, scores, unknown, 3))
    words = kernels.best_path(run, scores, unknown, 3)
    assert "".join(words) == run
    assert 1 + sum(scores.get(w, unknown) for w in words) == pytest.approx(best)
    losses = kernels.path_losses(run, scores, unknown, 3)
    assert [w for w, _ in losses] == words
    at = 0
    for word, loss in losses:
        k = len(word)
        other = max((s for s, _ in all_paths(run, scores, unknown, 3, (at, k))), default=None) if k > 1 else None
        assert loss == pytest.approx(best - other if k > 1 else scores.get(word, unknown) - unknown, abs=1e-9)
        at += k


def test_engines_agree_and_conserve_text(spark):
    rng = random.Random(3)
    words = [("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 4))), rng.randint(0, 50)) for _ in range(60)]
    texts = ["".join(rng.choice("甲乙丙丁 a1，") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    left, right = cuts(spark, words, texts), cuts(spark, words, texts, "native")
    assert left == right
    normal = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i").select(T.normalize_spaces(F.col("text")).alias("t")).collect()]
    assert ["".join(t) for t in left] == normal
    cutter = Cutter(spark, frame(spark, words))
    assert [list(r.tokens) for r in cutter.cut_df(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()] == left
    assert cutter.cut(texts[0]) == left[0]
    cutter.register("cut_words")
    assert list(spark.createDataFrame([(texts[1],)], "t string").selectExpr("cut_words(t) as w").first().w) == left[1]


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "英国人Tom 来"), (2, ""), (3, "英国，英")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in S.segment_longest_match(docs, frame(spark, G3)).collect()}
    assert got == {1: ["英国人", "T", "o", "m", " ", "来"], 2: [], 3: ["英国", "，", "英"]}


def test_count_filters(spark):
    lines = spark.createDataFrame([("甲 乙  甲 \t",), ("丙",)], "value string")
    every = {r.word: r.freq for r in S.recount(lines).collect()}
    assert every == {"甲": 2, "乙": 1, "丙": 1}
    assert {r.word for r in S.recount(lines, frame(spark, [("甲", 1)])).collect()} == {"甲"}
    assert S.recount(lines, frame(spark, [])).count() == 3


def test_training_shrinks_to_the_target(spark):
    rng = random.Random(1)
    words = ["甲乙", "丙丁戊", "己庚", "辛"]
    corpus = spark.createDataFrame([("".join(rng.choice(words) for _ in range(12)) + "。",) for _ in range(300)], "text string")
    seed = L.seed_lexicon(S.runs_of(S.chunk_counts(corpus)), 20)
    rounds = []
    got = {r.word: r.freq for r in train(corpus, seed, vocabulary=9, least=5, on_round=lambda k, df: rounds.append(df.count())).collect()}
    assert {"甲乙", "丙丁戊", "己庚"} <= set(got) and len(got) <= 12 and rounds == sorted(rounds, reverse=True)
    assert sum(len(w) * f for w, f in got.items()) == sum(len(r.text) - 1 for r in corpus.collect())


def test_prune_keeps_singles_and_the_best(spark):
    losses = spark.createDataFrame([("甲", 0.0, 9), ("乙丙", 8.0, 4), ("丙丁", 1.0, 16), ("丁戊", 9.0, 1), ("戊己", 8.0, 4)], "word string, loss double, cnt long")
    lexicon = frame(spark, [("甲", 9), ("己", 1), ("乙丙", 4), ("丙丁", 16), ("丁戊", 1), ("戊己", 4)])
    kept = {r.word for r in L.keep_by_loss(losses, lexicon, 4, 2).collect()}
    assert kept == {"甲", "己", "乙丙", "戊己"}


def test_texts(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r

    assert one(T.clean_text, "# A\n\nb\n## C\r\n d　 e ") == "b d e"
    assert one(T.clean_text, "#\n\nb\nc") == "c"
    assert one(T.sentences, "真的吗？！ 好。 ") == ["真的吗？", "！", "好。"]
    assert one(T.strip_headings, "a\n# b\nc") == "a\n\nc"
    assert one(lambda c: T.unescape_title(c), "A_b\\'c\\\\d") == "A b'c\\d"
    assert one(lambda c: T.to_simplified(c, {"漢": "汉"}), "漢字") == "汉字"
    assert [one(lambda c: T.char_count(c, True), w) for w in ("é", "汉字", "ab")] == [0, 2, 2]


def test_phrases(spark):
    convert = phrase_converter(spark, {"乾": "干", "乾坤": "乾坤", "頭髮": "头发", "髮": "发"})
    rows = spark.createDataFrame([("乾坤乾頭髮x",), (None,)], "t string").coalesce(1)
    assert [r.r for r in rows.select(convert(F.col("t")).alias("r")).collect()] == ["乾坤干头发x", None]


def test_titles(spark):
    titles = spark.createDataFrame([("中华人民",), ("中华人民共和国",), ("中华",), ("国家列表",), ("单",), ("A字",), (" 约翰·多恩 ",)], "title string")
    assert {r.title for r in L.good_titles(titles).collect()} == {"中华人民", "中华", "约翰·多恩"}
    assert {r.title for r in L.good_titles(spark.createDataFrame([("中華",), ("国家列錶",)], "title string"), mapping={"華": "华", "錶": "表"}).collect()} == {"中华"}


def test_dumps(spark):
    lines = spark.createDataFrame([("INSERT INTO `p` VALUES (7,0,'A_\\'b','x,(1)',0.5),(8,1,'c','',NULL);",), ("-- VALUES (9,0,'z','',1)",)], "value string")
    rows = [r.fields for r in dumps.insert_tuples(lines).collect()]
    assert rows == [["7", "0", "A_\\'b", "x,(1)", "0.5"], ["8", "1", "c", "", "NULL"]]
    pages = dumps.pages(dumps.insert_tuples(lines))
    assert dumps.redirects(spark.createDataFrame([(["7", "0", "a\ufffd"],), (["8", "0", "b"],)], "fields array<string>")).first() == (8, "b")
    redirects = spark.createDataFrame([(7, "T"), (8, "U")], "rd_from long, rd_title string")
    assert [tuple(r) for r in dumps.redirect_pairs(pages, redirects).collect()] == [("A 'b", "T")]


def test_wikitext(spark):
    source = "{{x|{{y}}}}\n* '''甲/乙'''：'''丙丁''' '''戊己庚'''\n'''no'''\n** '''[辛]壬癸''' 的'''简称子丑寅'''\n* '''寅卯'''"
    words = {r.word for r in dumps.list_words(spark.createDataFrame([(source,)], "source string")).collect()}
    assert words == {"甲", "乙", "戊己庚", "辛壬癸", "子丑寅", "寅卯"}
    deep = "{{" * 60 + "x" + "}}" * 60 + "\n*'''天'''"
    assert [r.word for r in dumps.list_words(spark.createDataFrame([(deep,)], "source string")).collect()] == ["天"]
    for bad in ("{{a", "* '''x"):
        with pytest.raises(Exception, match="unbalanced|unclosed"):
            dumps.list_words(spark.createDataFrame([(bad,)], "source string")).collect()


def test_retries():
    answers = [(429, {"Retry-After": "3"}, ""), (429, {}, ""), (200, {}, "text")]
    waited = []
    assert dumps.send_with_retries(lambda: answers.pop(0), sleep=waited.append) == "text" and waited == [3, 0]
    with pytest.raises(OSError, match="404"):
        dumps.send_with_retries(lambda: (404, {}, ""), sleep=waited.append)
    with pytest.raises(OSError, match="10 attempts"):
        dumps.send_with_retries(lambda: (429, {}, ""), sleep=waited.append)


def test_retry_delay():
    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    assert [dumps.retry_delay(h, now) for h in (None, "12", "Wed, 01 Jan 2025 00:00:30 GMT", "Wed, 01 Jan 2020 00:00:00 GMT", "soon")] == [0, 12, 30, 0, 0]
