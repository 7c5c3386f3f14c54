"""Many runs at once give what the kernels give run by run, and nothing is shuffled by run."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiloom.operators import kernels, vector
from lexiloom.operators import segment as S


class Shared:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("longest", [1, 3, 6])
def test_paths_losses_and_matches_as_run_by_run(longest):
    rng = random.Random(longest)
    word = lambda n: "".join(rng.choice("甲乙丙𠀀") for _ in range(n))
    for _ in range(20):
        scores = {word(rng.randint(1, longest)): -rng.randint(1, 4) / 2 for _ in range(25)}
        most, unknown = max(map(len, scores)), -rng.random() * 5
        runs = [*(word(rng.randint(1, 30)) for _ in range(40)), "丁", "甲"]
        n = [rng.randint(1, 9) for _ in runs]
        batch = pa.RecordBatch.from_arrays([pa.array(runs), pa.array(n)], names=["chunk", "n"])
        trie = Shared(vector.Trie(scores, unknown))
        cut = lambda **k: next(vector.cut_column(trie, **k)([batch])).column(1).to_pylist()  # noqa: E731, B023
        assert cut() == [kernels.best_path(r, scores, unknown, most) for r in runs]
        assert cut(match=True) == [kernels.longest_match(r, scores, most) for r in runs]
        wanted = {}
        for r, k in zip(runs, n, strict=True):
            for w, x in kernels.path_losses(r, scores, unknown, most):
                loss, cnt = wanted.get(w, (0, 0))
                wanted[w] = loss + k * x, cnt + k
        got = {w: (x, c) for w, x, c in zip(*(c.to_pylist() for c in next(vector.summed_losses(trie)([batch])).columns), strict=True)}
        assert got.keys() == wanted.keys() and all(got[w] == pytest.approx(wanted[w]) for w in got)


def test_no_words_and_no_runs():
    trie = vector.Trie({}, -1.0)
    assert vector.Runs(pa.array(["甲乙", ""]), trie).best(-1.0)[0].tolist() == [1, 1]
    assert vector.Runs(pa.array([], pa.string()), vector.Trie({"甲": 0.0})).starts(np.zeros(0, np.int64)).tolist() == []


def test_counts_and_losses_shuffle_words_alone(spark):
    chunks = spark.createDataFrame([("甲乙", 3, True), ("乙", 2, True), ("x", 1, False)], "chunk string, n long, han boolean")
    words = spark.createDataFrame([("甲乙", 5), ("乙", 2)], "word string, freq long")
    for rows in (S.token_counts(chunks, words), S.word_loss(chunks, words)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(chunk" not in plan
    assert {(r.word, r.freq) for r in S.token_counts(chunks, words).collect()} == {("甲乙", 3), ("乙", 2), ("x", 1)}


def test_texts_are_read_once_for_seeds_and_characters(spark, tmp_path, monkeypatch):
    from lexiloom.operators import lexicon as L
    from lexiloom.plans import catalog

    spark.createDataFrame([(1, " abc · de'f 甲a  b "), (2, "3x, A-Z　é"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    han = catalog._han(spark, str(tmp_path))
    assert {tuple(r) for r in L.char_counts(han).collect()} == {tuple(r) for r in L.char_counts_of(S.chunk_counts(han)).collect()}
    read, asked = catalog._documents, []
    monkeypatch.setattr(catalog, "_documents", lambda *given: asked.append(1) or read(*given))
    for query in (catalog.lexicon_char_filter, catalog.lexicon_add_singles):
        asked.clear()
        query(spark, str(tmp_path)).collect()
        assert len(asked) == 1
