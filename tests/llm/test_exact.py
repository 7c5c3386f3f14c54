"""Operators whose results have an exact plain-Python counterpart."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import decontaminate, simhash, suffixdedup

from . import brute

DOCS = "doc_id long, text string, lang string, fp string, seg long, length long, words string"


def table(spark, rows):
    """A documents table with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, "x", 1, 2, "w") for d, t in rows], DOCS)


def words(rng, n, vocabulary=40):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") * rng.randint(1, 3) + str(rng.randrange(vocabulary)) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 200), 5000) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k % 5]) for k in range(20)]
    rows += [(200 + k, base[k] + " " + words(rng, 1)) for k in range(10)]
    rows += [(300 + k, words(rng, 15, 5000) + " " + base[3][:260] + " " + words(rng, 15, 5000)) for k in range(8)]
    return [*rows, (400, None), (401, ""), (402, "  \n\t "), (403, "one"), (403, "one"), (None, base[0]), (404, "Ä É ß 日本 " * 30), (405, "x" * 900)]


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("block", [10**6, 5])
def test_decontamination(spark, mixed, block):
    rng = random.Random(1)
    texts = [t for _, t in mixed if t and len(t.split()) > 30]
    items = [(k, " ".join(t.split()[k : k + 14]).upper()) for k, t in enumerate(texts[:12])] + [(50, "one"), (51, None), (52, ""), (7, "one"), (53, words(rng, 30))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, segment string")
    got = decontaminate.contamination(table(spark, mixed), benchmark, block=block)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got, columns) == sorted(brute.contaminated(mixed, items), key=repr)


def test_decontamination_of_empty_tables(spark):
    empty = table(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert rows(decontaminate.contamination(table(spark, [(1, "a b")]), benchmark), ["n_hit", "contaminated"]) == [(0, False)]


def test_proximity_finds_a_phrase_with_an_inserted_word(spark):
    index = decontaminate.build_index(table(spark, [(1, "p q alpha beta x gamma delta r"), (2, "alpha beta gamma delta"), (3, "gamma alpha")]))
    benchmark = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    found = lambda **k: sorted(r[0] for r in decontaminate.find_matches(index, benchmark, **k).where(F.size("spans") > 0).select("doc_id").collect())
    assert found() == [2]
    assert found(slop=1) == [1, 2]
    near = decontaminate.contamination(table(spark, [(1, "p q alpha beta x gamma delta r"), (2, "alpha beta gamma delta"), (3, "beta gamma delta alpha"), (4, "delta gamma beta alpha")]), benchmark)
    assert rows(near, ["doc_id", "n_items", "n_near"]) == [(1, 0, 1), (2, 1, 1), (3, 0, 1), (4, 0, 0)]


def test_simhash(spark, mixed):
    got = simhash.near_duplicates(table(spark, mixed))
    assert rows(got, ["doc_id", "fingerprint", "component_id"]) == sorted(brute.near(mixed), key=repr)


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    local = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(simhash.near_duplicates(docs), ["doc_id", "fingerprint", "component_id"]) == sorted(brute.near(local), key=repr)


def test_golay_keys_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    tables = simhash.golay_tables()
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    left, right = (set(zip(*map(np.ndarray.tolist, simhash.golay_keys(x, tables)), strict=True)) for x in (a, b))
    assert {r for r, _ in left & right} == set(range(len(a)))


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "BLOCK", 8)
    fp = [1 << a for a in range(12)] + [(1 << a) | (1 << 40) for a in range(12)] + [0]
    batches = [simhash.pa.record_batch({"key": np.zeros(len(fp), np.int64), "fp": np.array(fp, np.int64)})]
    out = [r for b in simhash._link_batches(iter(batches)) for r in b.to_pylist()]
    assert {r["kind"] for r in out} == {1} and sorted(r["a"] for r in out) == sorted(fp) and {r["b"] for r in out} == {1, 2, 3, 4}
    assert len(simhash.forest(np.array(fp))) == len(fp) - 1


@pytest.mark.parametrize("length", [60, 400])
def test_substrings(spark, mixed, length):
    got = suffixdedup.remove_repeated_substrings(table(spark, mixed), length)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(got, columns) == sorted(brute.substrings(mixed, length), key=repr)


def test_substrings_on_documents(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    local = [(r.doc_id, r.text) for r in docs.collect()]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(suffixdedup.remove_repeated_substrings(docs), columns) == sorted(brute.substrings(local, 400), key=repr)


@pytest.mark.parametrize("own", [False, True])
def test_substrings_against_sql(spark, mixed, own):
    import duckdb
    import pandas as pd

    docs = table(spark, mixed) if own else spark.read.parquet(f"{brute.SF}/documents.parquet")
    base = duckdb.connect()
    if own:
        base.register("documents", pd.DataFrame(mixed, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    else:
        base.sql(f"CREATE VIEW documents AS SELECT * FROM '{brute.SF}/documents.parquet'")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"]
    expected = base.sql(f"SELECT {', '.join(columns)} FROM ({suffixdedup.oracle_sql()})").fetchall()
    assert rows(suffixdedup.remove_repeated_substrings(docs), columns) == sorted(expected, key=repr)


def test_substrings_of_long_repeats(spark):
    rng = random.Random(9)
    morse = "ab"
    while len(morse) < 6000:
        morse += morse.translate(str.maketrans("ab", "ba"))
    noise = "".join(rng.choice("acgt") for _ in range(3000))
    local = [(1, "x" * 100_000), (2, morse[:5000]), (3, morse[1000:2500] + "y"), (4, "ab" * 700), (5, noise), (6, noise[500:900] + "Z" + noise[1500:1899]), (7, noise[:399]), (8, "é" * 199 + "x" + "é" * 199), (10, noise[2000:2270] + "Y"), (9, "x" * 399)]
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffixdedup.remove_repeated_substrings(table(spark, local))
    assert rows(got, columns) == sorted(brute.substrings(local, 400), key=repr)
    shared = {d: n for d, n in rows(got, ["doc_id", "n_shared"])}
    assert shared[6] >= 400 and shared[7] > 0 and shared[5] >= 799 and shared[10] > 0 and shared[1] == 100_000


@pytest.mark.parametrize("length", [20, 127, 128, 150, 400])
def test_blocks_tell_equal_prefixes(length):
    import numpy as np

    rng = random.Random(length)
    for letters in ("a", "ab", "abcdefgh"):
        base = "".join(rng.choice(letters) for _ in range(1500))
        parts = [base[a : a + rng.randint(length, 900)] for a in (0, 3, 31, 100, 250, 251, 577)] + ["".join(rng.choice(letters) for _ in range(700))]
        near = base[:600]
        parts += [near[:k] + "z" + near[k + 1 :] for k in (31, 32, 200, 300)]
        text = "".join(parts).encode()
        edges = np.cumsum([0] + [len(p) for p in parts])
        starts = np.concatenate([np.arange(a, max(a, b - length + 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        own = [text[s : s + length] for s in starts]
        seen = {}
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        assert suffixdedup.block_ties(np.frombuffer(text, np.uint8), starts, length).tolist() == [seen[x] > 1 for x in own]


def test_a_false_tie_of_fingerprints_is_refuted():
    import numpy as np
    import pyarrow as pa

    from lexiloom.llm import kernels as K

    rng = random.Random(2)
    text = "".join(rng.choice("acgt") for _ in range(1000)).encode()
    run = {"seg": 1, "doc_ids": [1, 2], "lengths": K.packed(np.array([600, 400], np.int64)), "text": K.packed(np.frombuffer(text, np.uint8)), "refuted": None}
    run["runs"] = K.packed(np.array([0, 600, 5, 601]))
    assert suffixdedup._confirmed(run, 400).tolist() == [0, 1, 2, 3, 4, 600]
    stretches = [r for b in suffixdedup._stretch_rows(400, 1)(iter([pa.RecordBatch.from_pylist([run])])) for r in b.to_pylist()]
    wrong = suffixdedup._sort_block(400)(pa.Table.from_pylist(stretches, pa.schema([("block", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("content", pa.binary())])))
    run["refuted"] = wrong.to_pylist()
    assert suffixdedup._confirmed(run, 400).tolist() == []


def test_difference_cover():
    for q in (2, 3, 5, 17):
        cover, v = suffixdedup.difference_cover(q)
        assert {(x - y) % v for x in cover for y in cover} == set(range(v))


def test_empty_tables(spark):
    empty = table(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert suffixdedup.remove_repeated_substrings(empty).count() == 0
