"""Order-dependent suppression against a sequential fold, and templates of any depth."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import lexicon as L
from lexiloom.operators import ordered
from lexiloom.sources import dumps


def fold(titles):
    """(place, title) of the titles that stay, one after the other."""
    out, before = [], None
    for i, t in enumerate(titles):
        if before and len(before) >= 4 and t.startswith(before):
            continue
        out.append((i, t))
        before = t
    return out


def some_titles(rng, n):
    roots = ["".join(rng.choice("的一是不") for _ in range(rng.randrange(2, 7))) for _ in range(12)]
    return [rng.choice(roots) + "".join(rng.choice("了人") for _ in range(rng.randrange(0, 4))) for _ in range(n)]


@pytest.mark.parametrize("kind", ["shuffled", "sorted", "one family", "runs", "few"])
def test_suppression_in_any_order(spark, kind):
    rng = random.Random(kind)
    titles = some_titles(rng, 3 if kind == "few" else 700)
    if kind == "sorted":
        titles.sort()
    elif kind == "one family":
        titles = ["的一是不"] + ["的一是不" + t for t in titles]
    elif kind == "runs":
        titles = [t for t in titles[:40] for _ in range(30)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(titles)], "line int, title string, title_part int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = ordered.suppress_in_order(rows)
        assert got.columns == ["line", "title", "title_part"]
        assert sorted((r["line"], r["title"]) for r in got.collect()) == fold(titles)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_states_at_any_cuts():
    rng = random.Random(1)
    for _ in range(300):
        titles = sorted(some_titles(rng, 60)) if rng.random() < 0.5 else some_titles(rng, 60)
        cuts = [0, *sorted(rng.sample(range(1, 60), rng.randrange(0, 20))), 60]
        parts = [titles[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        summaries = [(k, ordered.commonprefix(p), ordered.accepted(p, "")[1]) for k, p in enumerate(parts)]
        before = ordered.states(summaries)
        assert [s for k, p in enumerate(parts) for s in ordered.accepted(p, before[k])[0]] == ordered.accepted(titles, "")[0]


def test_nothing_to_suppress(spark):
    empty = spark.createDataFrame([(1, None)], "line int, title string")
    assert ordered.suppress_in_order(empty).count() == 0
    assert ordered.good_titles_in_order(empty.limit(0)).count() == 0


def test_good_titles_in_the_order_of_a_file(spark, tmp_path):
    titles = ["中国人民银行", "中国人民", "中国人民银行", "x", "人", "大学列表", "大學", "大学", "大学", "中国人民"]
    (tmp_path / "t.txt").write_text("\n".join(f" {t} " for t in titles) + "\n")
    (tmp_path / "c.txt").write_text("學\t学\n")
    cli.run(spark, ["titles", str(tmp_path / "t.txt"), str(tmp_path / "out"), "--convert", str(tmp_path / "c.txt")])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["中国人民银行", "中国人民", "大学", "大学", "大学", "中国人民"]
    # sorted titles: the same as by the join
    rng = random.Random(5)
    rows = spark.createDataFrame(list(enumerate(sorted(set(some_titles(rng, 400))))), "line int, title string")
    assert {r["title"] for r in ordered.good_titles_in_order(rows).collect()} == {r["title"] for r in L.good_titles(rows).collect()}


def plain_trim(text):
    out, depth, i = "", 0, 0
    while i < len(text):
        if text[i : i + 2] in ("{{", "}}"):
            depth += 1 if text[i] == "{" else -1
            assert depth >= 0
            i += 2
        else:
            out += "" if depth else text[i]
            i += 1
    assert not depth
    return out


def test_templates(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["{{", "}}", "{", "}", "a", "\n"]) for _ in range(rng.randrange(12))) for _ in range(600)] + ["", "中{{文}}字"]
    for text in texts:
        try:
            wanted = plain_trim(text)
        except AssertionError:
            with pytest.raises(ValueError):
                dumps.without_templates(text)
        else:
            assert dumps.without_templates(text) == wanted
    deep = "a" + "{{x" * 100_000 + "}}" * 100_000 + "b"
    began = time.time()
    rows = spark.createDataFrame([(deep,), (None,)], "source string").select(dumps.trim_templates(F.col("source")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["ab", None] and time.time() - began < 30
    with pytest.raises(Exception, match="unbalanced template"):
        spark.createDataFrame([("{{a",)], "source string").select(dumps.trim_templates(F.col("source"))).collect()
