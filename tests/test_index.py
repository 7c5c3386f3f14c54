"""The shared index of words against the plain kernels, alone and through every way to cut row by row."""

import base64
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom import api
from lexiloom.operators import index, kernels
from lexiloom.operators import segment as S
from lexiloom.streaming.pipe import cut_stream

LETTERS = [chr(0x4E00 + i) for i in range(40)] + ["\U00020000", "\U00020001"]


def lexicon_of(rng, count):
    words = {"".join(rng.choices(LETTERS, k=rng.choice([1, 2, 2, 3, 4, 7]))) for _ in range(count)}
    return {w: rng.choice([-3.0, -5.0, -8.0, -10 * rng.random()]) for w in sorted(words)}


def laid_out(folder, scores, parts=3, block=7):
    rows, files = list(scores.items()), []
    for i in range(parts):
        own = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        files.append(folder / f"part-{i}")
        with open(files[-1], "wb") as out:
            for at in range(0, len(own), block):
                some = own[at : at + block]
                data = np.uint32(len(some)).tobytes() + np.array([len(w) for w, _ in some], "<u4").tobytes() + np.array([x for _, x in some]).tobytes()
                out.write(base64.b64encode(data + "".join(w for w, _ in some).encode("utf-32-le")) + b"\n")
    index.lay_out(files, str(folder / "index"))
    return index.PrefixIndex(str(folder / "index"))


@pytest.mark.parametrize("places", [1, 5, 64, 1 << 18])
def test_index_gives_what_the_kernels_give(tmp_path, monkeypatch, places):
    monkeypatch.setattr(index, "PLACES", places)
    rng = random.Random(places)
    scores = lexicon_of(rng, 600)
    words, longest = list(scores), max(map(len, scores))
    found = laid_out(tmp_path, scores)
    runs = ["", "𠀀", "a\U0010ffffz", "".join(rng.choices(LETTERS, k=3000)), *("".join(rng.choices(LETTERS, k=rng.randrange(30))) for _ in range(60)), *("".join(rng.choices(words, k=5)) for _ in range(60))]
    for unknown in (-12.0, 0.0):
        assert index.best_paths(runs, found, unknown) == [kernels.best_path(r, scores, unknown, longest) for r in runs]
    assert index.longest_matches(runs, found) == [kernels.longest_match(r, scores, longest) for r in runs]
    # every word at every place
    letters = index._letters(runs[:8])
    text = "".join(r + "\0" for r in runs[:8])
    expected = [(i, k, text[i : i + k]) for i in range(len(text)) for k in range(1, longest + 1) if text[i : i + k] in scores and i + k <= len(text)]
    place, size, row = found.found(letters, 0, len(letters))
    assert [(p, k, words[r]) for p, k, r in zip(place.tolist(), size.tolist(), row.tolist(), strict=True)] == expected


def test_index_without_words(tmp_path):
    found = laid_out(tmp_path, {})
    assert index.best_paths(["ab", ""], found, 0.0) == [["a", "b"], []]
    assert index.longest_matches(["ab"], found) == [["a", "b"]]
    assert index.best_paths([], found, 0.0) == []


@pytest.fixture
def lexicon(spark):
    rng = random.Random(4)
    scores = lexicon_of(rng, 400)
    return spark.createDataFrame([(w, rng.randrange(0, 90)) for w in scores], "word string, freq bigint").cache()


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices([*LETTERS, " ", "a", "7", "，", "\n"], k=rng.randrange(60))) for _ in range(300)]
    return spark.createDataFrame([*enumerate(texts), (7, None), (8, ""), (7, texts[7]), (900, "".join(rng.choices(LETTERS, k=5000)))], "doc_id int, text string").repartition(3)


def rows_of(df):
    return sorted((r["doc_id"], r["tokens"]) for r in df.select("doc_id", F.array_join("tokens", "|").alias("tokens")).collect())


def test_engine_index(spark, lexicon, docs):
    assert rows_of(S.cut(docs, lexicon, engine="index")) == rows_of(S.cut(docs, lexicon))
    assert rows_of(S.segment_longest_match(docs, lexicon, engine="index")) == rows_of(S.segment_longest_match(docs, lexicon))
    runs = S.runs_of(S.chunk_counts(docs))
    read = lambda df: sorted((r["chunk"], r["tokens"]) for r in df.collect())
    assert read(S.cut_runs(runs, lexicon, engine="index")) == read(S.cut_runs(runs, lexicon))
    empty = lexicon.where("false")
    assert rows_of(S.cut(docs, empty, engine="index")) == rows_of(S.cut(docs, empty))
    assert rows_of(S.segment_longest_match(docs, empty, engine="index")) == rows_of(S.segment_longest_match(docs, empty))
    assert S.cut(docs.where("false"), lexicon, engine="index").count() == 0


def test_many_parts_keep_the_order_of_words(spark, lexicon, docs, monkeypatch):
    monkeypatch.setattr(index, "PART_WORDS", 30)
    files = index.write_index(S.Model(lexicon).frame, lexicon.count())
    found = files.open()
    words = [bytes(found.letters[found.starts[i] : found.starts[i + 1]]).decode("utf-32-le") for i in range(found.count)]
    assert words == sorted(r["word"] for r in lexicon.collect()) and len(files.parts) > 5


def test_rows_are_cut_with_lexicons_over_the_broadcast_limit(spark, lexicon, docs, monkeypatch):
    expected = rows_of(S.cut(docs, lexicon))
    small = api.Cutter(spark, lexicon)
    monkeypatch.setattr(S, "BROADCAST_WORDS", 20)
    over = S.cut(docs, lexicon)
    assert "Join" not in over._jdf.queryExecution().executedPlan().toString()
    assert rows_of(over) == expected
    large = api.Cutter(spark, lexicon)
    texts = docs.where("text is not null")
    assert rows_of(large.cut_df(texts)) == rows_of(S.cut(texts, lexicon))
    assert large.cut_df(docs).where("text is null").select("tokens").collect() == [(None,)]
    for text in (r["text"] for r in docs.limit(40).collect()):
        if text is not None:
            assert large.cut(text) == small.cut(text)
    large.register("cut_large")
    assert rows_of(texts.select("doc_id", F.expr("cut_large(text) as tokens"))) == rows_of(S.cut(texts, lexicon))
    got = cut_stream(docs.withColumnRenamed("text", "value"), lexicon)
    assert rows_of(got.where("value is not null")) == rows_of(small.cut_df(docs).where("text is not null"))
    monkeypatch.setattr(index, "INDEX_WORDS", 30)
    with pytest.raises(ValueError, match="30 words"):
        api.Cutter(spark, lexicon)
    assert rows_of(S.cut(docs, lexicon)) == expected


def test_workers_that_come_at_once_lay_out_one_index(spark, lexicon):
    files = index.write_index(S.Model(lexicon).frame, lexicon.count())
    made = []
    real = index.lay_out

    def counted(parts, folder):
        made.append(folder)
        real(parts, folder)

    index.lay_out = counted
    try:
        with ThreadPoolExecutor(8) as pool:
            opened = list(pool.map(lambda _: index.IndexFiles(files.name, files.parts).open(), range(8)))
    finally:
        index.lay_out = real
    assert len(made) == 1 and {o.count for o in opened} == {lexicon.count()}
