"""Files, command line, streams and the registered queries."""

import duckdb
import pytest

from lexiloom import cli
from lexiloom.operators import lexicon as L
from lexiloom.plans import catalog
from lexiloom.sources import files
from lexiloom.streaming import pipe

SF = "/root/testdata/sf0.001"


@pytest.fixture
def lexicon_file(tmp_path):
    path = tmp_path / "dict.txt"
    path.write_text("他\t50\n是\t40x\n\n英国\t80\n英国人\t 100\n人 30\n\t9\n", encoding="utf-8")
    return str(path)


def lines(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text(encoding="utf-8").splitlines())


def test_readers(spark, lexicon_file, tmp_path):
    got = sorted(tuple(r) for r in files.read_lexicon(spark, lexicon_file).collect())
    assert got == sorted([("他", 50), ("是", 40), ("英国", 80), ("英国人", 100)])
    assert {r.word for r in files.read_words(spark, lexicon_file).collect()} == {"他", "是", "英国", "英国人", "人"}
    for bad in ("坏\tx", "大\t99999999999999999999"):
        (tmp_path / "bad.txt").write_text(f"好\t3\n{bad}\n", encoding="utf-8")
        with pytest.raises(Exception, match="no frequency"):
            files.read_lexicon(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(Exception, match="(?i)path"):
        files.read_lexicon(spark, str(tmp_path / "none")).collect()
    (tmp_path / "a.jsonl").write_text('{"title": "t", "text": "# h\\n  a  b"}\n\n{"title": "u"}\n{"text": ""}\n', encoding="utf-8")
    assert [r.text for r in files.process_articles(files.read_articles(spark, str(tmp_path / "a.jsonl"))).collect()] == ["a b"]


def test_command_line(spark, lexicon_file, tmp_path):
    corpus = tmp_path / "in.txt"
    corpus.write_text("他是英国人Tom\n\n英国人。他是\n", encoding="utf-8")

    def run(*argv):
        out = tmp_path / ("out-" + "-".join(a.strip("-") for a in argv[:1]))
        cli.run(spark, [*argv, str(corpus), str(out)])
        return lines(out)

    assert run("cut", "--dict", lexicon_file) == sorted(["他 是 英国人 Tom", "", "英国人 。 他 是"])
    assert run("segment", "--dict", lexicon_file) == sorted(["他 是 英国人 T o m", "", "英国人 。 他 是"])
    assert run("chars") == sorted(["他\t2", "是\t2", "英\t2", "国\t2", "人\t2"])
    assert run("sentences") == sorted(["他是英国人Tom", "英国人。", "他是"])
    assert run("count") == sorted(["他是英国人Tom\t1", "英国人。他是\t1"])
    assert [x.split("\t")[0] for x in run("prune", "--dict", lexicon_file)] == sorted(["他", "是", "英国", "英国人"])
    trained = dict(x.split("\t") for x in run("train", "--dict", lexicon_file, "--vocabulary", "3"))
    assert trained["英国人"] == "2"


def test_lexicon_built_in_stages(spark, tmp_path):
    (tmp_path / "articles").write_text("".join(f'{{"title": "t", "text": "# 标题\\n甲乙丙丁。甲乙戊{k}。丙丁甲乙！"}}\n' for k in range(8)), encoding="utf-8")
    (tmp_path / "words").write_text("甲乙\n丙丁\n乙丙\n甲己\n", encoding="utf-8")
    argv = ["build", str(tmp_path / "articles"), str(tmp_path / "words"), str(tmp_path / "stages")]
    cli.run(spark, [*argv, str(tmp_path / "one"), "--vocabulary", "4", "--min-count", "2"])
    built = dict(x.split("\t") for x in lines(tmp_path / "one"))
    assert built["甲乙"] == "24" and built["丙丁"] == "16" and "甲己" not in built
    (tmp_path / "articles").write_text("", encoding="utf-8")  # all stages are there
    cli.run(spark, [*argv, str(tmp_path / "two")])
    assert dict(x.split("\t") for x in lines(tmp_path / "two")) == built


def test_stream_equals_batch(spark, tmp_path):
    words = spark.createDataFrame([("他", 5), ("英国人", 9)], "word string, freq long")
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("他英国人\n  x  y\n", encoding="utf-8")
    (source / "b.txt").write_text("英国人他\n", encoding="utf-8")
    query = pipe.cut_to_lines(spark.readStream.text(str(source)), words).writeStream.format("text").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(out))
    query.awaitTermination()
    batch = sorted(r.value for r in pipe.cut_to_lines(spark.read.text(str(source)), words).collect())
    assert lines(out) == batch == sorted(["他 英国人", "x ▁ y", "英国人 他"])
    counts = pipe.running_counts(pipe.cut_stream(spark.readStream.text(str(source)), words)).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {r.word: r.freq for r in spark.table("running").collect()}["英国人"] == 2


def test_corpora_one_behind_the_other(spark):
    one, two = (spark.createDataFrame([(t,) for t in texts], "text string") for texts in (["a", "b"], ["a"]))
    rows, seen = files.counted(files.concat_corpora(one, two), "rows")
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "a"), (0, "b"), (1, "a")]
    assert seen.get["rows"] == 3


def test_filtered_lexicon_keeps_its_order(spark, tmp_path):
    (tmp_path / "chars").write_text("乙\t5\n甲\t9\n丙\t7\n丁\t1\n〇\t8\n", encoding="utf-8")
    (tmp_path / "words").write_text("乙甲\n甲\n甲丁\n乙乙\n甲\n", encoding="utf-8")
    cli.run(spark, ["filter-lexicon", str(tmp_path / "chars"), str(tmp_path / "words"), str(tmp_path / "out")])
    kept = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert kept == ["乙甲", "甲", "乙乙", "丙", "乙", "丁"]


def test_shared_folder_of_a_cluster_must_be_set():
    from types import SimpleNamespace as N

    from lexiloom import storage

    scala = N(getCheckpointDir=lambda: N(isEmpty=lambda: True))
    session = N(sparkContext=N(_jsc=N(sc=lambda: scala), master="local-cluster[3,2,3000]"), conf=N(get=lambda *_: None))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(session)


def test_char_filter(spark):
    counts = spark.createDataFrame([("甲", 5), ("乙", 1), ("〇", 3)], "ch string, cnt long")
    words = spark.createDataFrame([("甲甲",), ("甲乙",), ("丙",), ("",), ("甲甲",)], "word string")
    kept = L.filter_by_chars(words, counts, 2)
    assert [r.word for r in kept.collect()] == ["甲甲"]
    assert {r.word for r in L.add_single_chars(kept, counts).collect()} == {"甲甲", "甲", "乙"}


@pytest.fixture(scope="module")
def duck():
    base = duckdb.connect()
    for t in ("documents", "benchmark", "part", "customer", "orders"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return base


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n != "em_train"])
def test_queries_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    expected = duck.sql(sql)
    assert sorted(expected.columns) == columns
    assert rows == sorted(repr(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


@pytest.mark.parametrize("target", [catalog.TARGET, 90])
def test_training_against_sql(spark, duck, monkeypatch, target):
    monkeypatch.setattr(catalog, "TARGET", target)  # of the smaller one several rounds are needed
    got = sorted(tuple(r) for r in catalog.em_train(spark, SF).select("word", "freq").collect())
    assert got == sorted(duck.sql(catalog.oracle_sql()["em_train"]).select("word, freq").fetchall())
    assert 0 < len(got) <= target and min(n for _, n in got) > 0


def test_command_line_for_lexicon_sources(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    def run(*argv):
        out = tmp_path / f"out-{argv[0]}"
        cli.run(spark, [*argv, str(out)])
        return lines(out)

    titles = file("titles", "约翰·多恩\n中华\n中华人民共和国\nA字\n")
    assert run("titles", titles) == sorted(["约翰·多恩", "中华", "中华人民共和国"])
    page = file("page.sql", "INSERT INTO `page` VALUES (7,0,'甲_乙','',0),(8,1,'丙','',0);\n")
    redirect = file("redirect.sql", "INSERT INTO `redirect` VALUES (7,0,'丁','',''),(8,0,'戊','','');\n")
    assert run("redirects", page, redirect) == ["甲 乙\t丁"]
    assert run("wikitext", file("wiki", "* '''甲/乙'''：'''丙丁戊'''\n")) == sorted(["甲", "乙", "丙丁戊"])
    assert run("clean", file("a.jsonl", '{"text": "# h\\n 甲  乙 "}\n{"text": ""}\n')) == ["甲 乙"]
    slang, pairs = file("slang", "给力\n超过三个字\n"), file("pairs", "国\t英国人\n")
    assert run("lexicon", "--titles", titles, "--slang", slang, "--redirects", pairs) == sorted({"约翰", "多恩", "中华", "给力", "国", "英国人", *"约翰多恩中华给力英国人"})
