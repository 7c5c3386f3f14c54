"""Streams with lexicons of any size that are renewed while they run."""

import duckdb
import pytest

from lexiloom import cli
from lexiloom.operators import segment as S
from lexiloom.plans import catalog
from lexiloom.streaming import lexicons

SMALL = "/root/testdata/sf0.001"
OLD = [("他", 5), ("英国", 9), ("人", 4)]
NEW = [("他", 5), ("英国人", 90)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "word string, freq long")


@pytest.mark.parametrize("engine", ["auto", "native"])
def test_a_running_stream_takes_the_newest_version(spark, tmp_path, engine):
    source, folder, out = tmp_path / "in", str(tmp_path / "lexicon"), str(tmp_path / "out")
    source.mkdir()
    schema = "value string, `a b` int, tokens int, version string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))
    assert lexicons.publish(frame(spark, OLD), folder) == 1
    stream = lexicons.cut_batches(spark.readStream.schema(schema).parquet(f"{source}/*"), folder, out, str(tmp_path / "log"), engine=engine).start()
    try:
        put([("他英国人 x", 1, 7, "v"), (None, 2, 7, "v"), ("", 3, 7, "v")], "one")
        stream.processAllAvailable()
        assert lexicons.publish(frame(spark, NEW), folder) == 2
        (tmp_path / "lexicon" / "version=3").mkdir()  # not written as a whole
        put([("他英国人 x", 1, 7, "v")] * 2, "two")
        stream.processAllAvailable()
    finally:
        stream.stop()
    rows = spark.read.parquet(out).select("a b", "value", "tokens", "version").collect()
    assert sorted(((r["a b"], r.value, r.tokens, r.version) for r in rows), key=str) == sorted(
        [
            (1, "他英国人 x", ["他", "英国", "人", "▁", "x"], 1),
            (2, None, None, 1),
            (3, "", [], 1),
            *[(1, "他英国人 x", ["他", "英国人", "▁", "x"], 2)] * 2,
        ],
        key=str,
    )
    assert lexicons.publish(frame(spark, OLD), folder) == 3


def test_a_batch_that_comes_again_is_there_once(spark, tmp_path):
    source, out, log = tmp_path / "in", tmp_path / "out", tmp_path / "log"
    source.mkdir()
    run = lambda rows: lexicons.cut_batches(spark.readStream.text(str(source)), frame(spark, rows), str(out), str(log)).trigger(availableNow=True).start().awaitTermination()
    (source / "a.txt").write_text("他英国人\n他英国人\n", encoding="utf-8")
    run(OLD)
    forget = lambda: [f.unlink() for f in (log / "commits").glob("*0*")]
    forget()
    run(NEW)  # the batch is whole: left alone
    read = lambda: sorted(r.tokens for r in spark.read.parquet(str(out)).collect())
    assert read() == [["他", "英国", "人"]] * 2
    forget()
    (out / "batch=0" / "_SUCCESS").unlink()
    run(NEW)  # it isn't: written anew
    assert read() == [["他", "英国人"]] * 2


def test_command_line_with_versions(spark, tmp_path):
    (tmp_path / "dict").write_text("他\t5\n英国人\t9\n", encoding="utf-8")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("他英国人\nx  y\n", encoding="utf-8")
    cli.run(spark, ["publish", "--dict", str(tmp_path / "dict"), str(tmp_path / "versions")])
    cli.run(spark, ["stream", "--versions", str(tmp_path / "versions"), str(tmp_path / "in"), str(tmp_path / "out"), "--checkpoint", str(tmp_path / "log")])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/batch=*").collect()) == ["x ▁ y", "他 英国人"]


def test_lexicons_over_the_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S.Model.__init__, "__defaults__", (1,))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("他英国人\n\nab\n", encoding="utf-8")
    stream = lexicons.cut_batches(spark.readStream.text(str(tmp_path / "in")), frame(spark, NEW), str(tmp_path / "out"), str(tmp_path / "log"))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.tokens for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[], ["ab"], ["他", "英国人"]]
    with pytest.raises(ValueError):
        lexicons.Newest(str(tmp_path / "none")).get(spark)


def test_registered_query_against_sql(spark):
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    expected = sorted(base.sql(catalog.oracle_sql()["stream_cut_joined"]).select("item_id, tokens").fetchall())
    assert sorted((r.item_id, r.tokens) for r in catalog.stream_cut_joined(spark, SMALL).collect()) == expected and expected
