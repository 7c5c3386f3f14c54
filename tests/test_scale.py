"""Selection without a sort, conversion chains, and runs of any length, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.functions import convert
from lexiloom.operators import kernels, occurring, select
from lexiloom.operators import lexicon as L
from lexiloom.operators import segment as S
from lexiloom.sources import dumps, files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1, 20, 5000])
def test_best_k(spark, monkeypatch, few):
    monkeypatch.setattr(select, "FEW", few)
    rng = random.Random(few)
    scores = [rng.choice([0.0, -0.0, 1.5, 1.5, -3.0, 1e-310, -1e300, math.inf, -math.inf, None, rng.gauss(0, 1), rng.gauss(0, 1) ** 31]) for _ in range(400)]
    rows = [(s, rng.choice(["", "a", "ab", "é", "中", None]) if rng.random() < 0.5 else f"w{rng.randrange(300)}", i) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "s double, t string, i int").cache()
    key = lambda r: (-math.inf if r[0] is None else r[0] + 0.0, (r[1] or "").encode())
    for k in (0, 1, 37, 200, 399, 400, 1000):
        got = [(r["s"], r["t"]) for r in select.best_k(df, k, F.col("s"), F.col("t")).collect()]
        assert sorted(map(key, got)) == sorted(map(key, rows), reverse=True)[:k][::-1]
    nan = spark.createDataFrame([(float("nan"), "a"), (1.0, "b"), (math.inf, "c")], "s double, t string")
    assert {r["t"] for r in select.best_k(nan, 2, F.col("s"), F.col("t")).collect()} == {"a", "c"}


def test_pruning_sorts_nothing_in_one_task(spark):
    rng = random.Random(2)
    losses = [(f"{chr(0x4E00 + i)}{chr(0x4E00 + i % 90)}", rng.choice([1.0, 2.0, rng.random() * 9]), rng.randrange(1, 60)) for i in range(3000)]
    lexicon = spark.createDataFrame([(w, c) for w, _, c in losses] + [("的", 5), ("一", 6)], "word string, freq bigint")
    frame = spark.createDataFrame(losses, "word string, loss double, cnt bigint").cache()
    kept = L.keep_by_loss(frame, lexicon, 300, 15)
    assert "TakeOrdered" not in plan_of(kept) and "GlobalLimit" not in plan_of(kept)
    eligible = sorted(((x / math.sqrt(c) / 2, w) for w, x, c in losses if c >= 15), reverse=True)
    assert {r["word"] for r in kept.collect()} == {"的", "一"} | {w for _, w in eligible[: max(298, len(eligible) * 75 // 100)]}


def plain_conversion(text, *steps):
    for step in steps:
        tables = [step] if isinstance(step, dict) else step
        out, at = "", 0
        while at < len(text):
            options = [(len(k), -i, v) for i, t in enumerate(tables) for k, v in t.items() if k and text.startswith(k, at)]
            size, _, value = max(options, key=lambda o: o[:2], default=(1, 0, text[at]))
            out, at = out + value, at + size
        text = out
    return text


PHRASES = {"乾隆": "乾隆", "頭髮": "头发", "發展": "发展", "a.b": "[x]", "ab": "", "abcd": "D", "🙂x": "y"}
CHARS = {"乾": "干", "髮": "发", "發": "发", "頭": "头", "a": "é", "ab": "never"}
REGION = {"头发": "毛发", "é": "e"}


def test_conversion_chains(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("乾隆頭髮發展ab.cd🙂x\n ") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, "頭髮" * 3000]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, found int").repartition(3)
    for steps in ([PHRASES], [[PHRASES, CHARS]], [[PHRASES, CHARS], REGION], [CHARS], [{}], [{"乾": "干", "髮": "发"}, {"干": "千"}]):
        wanted = [(None if t is None else plain_conversion(t, *steps), i) for i, t in enumerate(texts)]
        got = df.withColumn("text", convert.converter(spark, *steps)(F.col("text"))).orderBy("found").collect()
        assert [tuple(r) for r in got] == wanted
        # tables as DataFrames, collected and joined
        flat = [{k: v for t in reversed([s] if isinstance(s, dict) else s) for k, v in t.items()} for s in steps]
        tables = [spark.createDataFrame(list(t.items()), "source string, target string") for t in flat]
        for engine in ("auto", "join"):
            got = convert.convert(df, "text", *tables, engine=engine).orderBy("found")
            assert got.columns == ["text", "found"] and [tuple(r) for r in got.collect()] == wanted


def test_conversion_tables_are_limited(spark, monkeypatch):
    monkeypatch.setattr(convert, "MOST_PHRASES", 2)
    with pytest.raises(ValueError):
        convert.converter(spark, PHRASES)
    table = spark.createDataFrame(list(PHRASES.items()), "source string, target string")
    assert convert.collected(table) is None
    assert convert.convert(spark.createDataFrame([("頭髮ab!",)], "text string"), "text", table).first()["text"] == "头发!"


def test_conversion_files_and_where_they_are_used(spark, tmp_path):
    (tmp_path / "phrases.txt").write_text("頭髮\t头发 頭发\n髮\t发\n\nnothing\n國\t国\n")
    (tmp_path / "region.txt").write_text("头发\t毛发\n")
    tables = [files.read_conversion(spark, str(tmp_path / f)) for f in ("phrases.txt", "region.txt")]
    assert {tuple(r) for r in tables[0].collect()} == {("頭髮", "头发"), ("髮", "发"), ("國", "国")}
    articles = spark.createDataFrame([("t", "# 頭髮\n\n頭髮 國"), ("t", None), ("t", " ")], "title string, text string")
    assert [r["text"] for r in files.process_articles(articles, tables=tables).collect()] == ["毛发 国"]
    titles = spark.createDataFrame([(" 頭髮國 ",), ("頭髮國家歌",), ("毛发国家",)], "title string")
    assert {r["title"] for r in L.good_titles(titles, tables=tables).collect()} == {"毛发国", "毛发国家"}
    assert {r["title"] for r in L.good_titles(titles, mapping=[{"頭髮": "x"}, {"國": "国"}]).collect()} == {"毛发国家"}
    pages = spark.createDataFrame([(1, "頭髮"), (2, "國")], "page_id bigint, page_title string")
    links = spark.createDataFrame([(1, "國"), (2, "髮")], "rd_from bigint, rd_title string")
    assert [tuple(r) for r in dumps.redirect_pairs(pages, links, tables=tables).collect()] == [("国", "发"), ("毛发", "国")]
    (tmp_path / "a.jsonl").write_text('{"title": "t", "text": "頭髮 國"}\n')
    cli.run(spark, ["clean", str(tmp_path / "a.jsonl"), str(tmp_path / "out"), "--convert", str(tmp_path / "phrases.txt"), "--convert", str(tmp_path / "region.txt")])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["毛发 国"]


def lexicon_of(rng, alphabet, n, longest):
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, longest + 1))) for _ in range(n)}
    return [(w, rng.randrange(1, 900)) for w in words]


def test_free_pieces(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("的一是不了") for _ in range(n)) for n in (1, 2, 300, 1000)] + ["的" * 700]
    lexicon = lexicon_of(rng, "的一是不了", 30, 3) + [("的的", 1)]
    words = spark.createDataFrame(lexicon, "word string, freq bigint")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key int, text string")
    found = {w for w, _ in lexicon if len(w) > 1}
    pieces = {}
    for r in occurring.free_pieces(rows, "key", "text", words, 3, 20).orderBy("key", "no").collect():
        pieces.setdefault(r["key"], []).append(r["piece"])
    for i, t in enumerate(texts):
        assert "".join(pieces[i]) == t
        at = 0
        for p in pieces[i][:-1]:
            at += len(p)
            assert not any(t[a : a + k] in found for k in (2, 3) for a in range(max(0, at - k + 1), at))
    assert pieces[4] == [texts[4]] and len(pieces[3]) > 5


def test_a_run_of_a_million_characters(spark):
    rng = random.Random(4)
    alphabet = "的一是不了人我在有他这中大来上国个到说们"
    # no word is another's repetition: paths of equal scores would be told apart by the rounding of long sums
    lexicon = [(w, f) for w, f in lexicon_of(rng, alphabet, 60, 4) if len(set(w)) == len(w)]
    frame = spark.createDataFrame(lexicon, "word string, freq bigint")
    run = "".join(rng.choice(alphabet) for _ in range(1_000_000))
    runs = spark.createDataFrame([(run, 1), ("的一是", 4)], "chunk string, n bigint")
    total = sum(f for _, f in lexicon)
    scores, unknown = {w: math.log(f / total) for w, f in lexicon}, math.log(1 / total)
    got = {r["chunk"]: r["tokens"] for r in S.cut_runs(runs, frame, engine="native").collect()}
    assert set(got) == {run, "的一是"}
    assert got[run] == kernels.best_path(run, scores, unknown, 4)
    matched = {r["chunk"]: r["tokens"] for r in S.match_segments(runs, frame, engine="native").collect()}
    assert matched[run] == kernels.longest_match(run, set(scores), 4)


def test_long_runs_without_free_places_and_their_losses(spark):
    lexicon = [("的的", 9), ("的的的", 30), ("的", 2), ("一", 5), ("一的", 3)]
    frame = spark.createDataFrame(lexicon, "word string, freq bigint")
    texts = ["的" * 900, "的一" * 700, "一" * 300 + "的" * 301 + "不" * 200 + "的一" * 40]
    runs = spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "chunk string, n bigint")
    total = sum(f for _, f in lexicon)
    scores, unknown = {w: math.log(f / total) for w, f in lexicon}, math.log(1 / total)
    got = {r["chunk"]: r["tokens"] for r in S.cut_runs(runs, frame, engine="native").collect()}
    assert got == {t: kernels.best_path(t, scores, unknown, 3) for t in texts}
    chunks = runs.withColumn("han", F.lit(True))
    small, joined = ({r["word"]: (r["loss"], r["cnt"]) for r in S.word_loss(chunks, frame, engine=e).collect()} for e in ("auto", "join"))
    assert small.keys() == joined.keys()
    assert all(small[w][1] == joined[w][1] and small[w][0] == pytest.approx(joined[w][0], abs=1e-6) for w in small)
    docs = spark.createDataFrame([(1, texts[0] + "，" + texts[2])], "doc_id bigint, text string")
    assert S.cut(docs, frame, engine="native").first()["tokens"] == S.cut(docs, frame).first()["tokens"]
