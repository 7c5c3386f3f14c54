"""Operators 11 to 13 against plain versions, the library and exact fractions."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import collocations, kernels, pieces, whitening
from lexiloom.llm.queries import tokenizer_path

DOCS = "doc_id bigint, text string, lang string, score double, word string"


def plain_collocations(rows, most, least, covered, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", low):
            words = re.findall("[^ \t]+", piece)
            own = counts.setdefault(lang or "und", Counter())
            totals[lang or "und"] += len(words)
            for k in range(1, most + 1):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in wanted.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in wanted.items()):
                continue
            s, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-s, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top])]
    return sorted(out)


def some_texts(rng, n):
    words = ["a", "b", "A", "cd", "é", "Éa", "x-y", "中", "​"]
    seps = [" ", " ", " ", "  ", "\t", ".", ", ", "\n", "! "]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most,least,covered,top", [(3, 3, 50, 40), (4, 2, 30, 1000), (2, 2, 50, 5)])
def test_collocations_equal_a_plain_count(spark, most, least, covered, top):
    rng = random.Random(most)
    rows = [(t, rng.choice(["en", "de", None])) for t in some_texts(rng, 60)] + [(None, "en"), ("", None), ("b b b b b b b b", "de"), ("one", "fr")]
    df = spark.createDataFrame([(i % 7, t, lang, 0.5, "w") for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    got = collocations.collocations(df, most, least, covered, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_collocations(rows, most, least, covered, top)


def test_collocations_of_long_texts_and_of_nothing(spark, monkeypatch):
    text = ". ".join(some_texts(random.Random(5), 300))
    buf, off = kernels.strings_bytes([text, None, "a b", text])
    cut = collocations._long_texts_cut(buf, off, 500)
    assert len(cut) > 20 and set(off) <= set(cut) and all(collocations.PIECE[buf[c]] for c in cut if c not in off)
    whole, parts = Counter(), Counter()
    for borders, found in ((off, whole), (cut, parts)):
        for i in range(len(borders) - 1):
            words, sizes, _, tokens = collocations.shard_of(buf[borders[i] : borders[i + 1]], np.array([0, borders[i + 1] - borders[i]]))
            if not len(tokens):
                continue
            ends = np.cumsum(sizes)
            names = [words[e - s : e].tobytes().decode() for e, s in zip(ends, sizes, strict=True)]
            ids, n = collocations.phrase_counts(tokens, np.arange(len(names)), 3, {})
            for *p, k in zip(*ids, n, strict=True):
                found[tuple(names[i] for i in p)] += int(k)
    assert whole == parts and len(whole) > 50
    monkeypatch.setattr(collocations, "BATCH", 3)  # many batches of first words give the same
    one = shard = collocations.shard_of(*kernels.strings_bytes([text]))
    few = collocations.phrase_counts(shard[3], np.arange(len(one[1])), 3, {})
    monkeypatch.setattr(collocations, "BATCH", 1 << 20)
    many = collocations.phrase_counts(shard[3], np.arange(len(one[1])), 3, {})
    assert sorted(zip(*few[0], few[1], strict=True)) == sorted(zip(*many[0], many[1], strict=True))
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 0.0, "")], DOCS)).count() == 0


def test_bitmaps_shift_over_blocks():
    tokens = np.array([0, 1] * 40 + [-1, 0, 1, 1], np.int32)
    ids, n = collocations.phrase_counts(tokens, np.array([10, 20]), 2, {})
    assert dict(zip(zip(*ids, strict=True), n, strict=True)) == {(10, 20): 41, (20, 10): 39, (20, 20): 1}


def test_score_of_large_counts(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(collocations.score(F.lit(big), F.lit(big + 7), F.lit(big + 11)).alias("s")).first()
    assert row["s"] == 1_000_000 * big * big // ((big + 7) * (big + 11))


MODEL = tokenizer_path("piece_bpe_32k.model")


def hard_texts(model, rng):
    alphabet = "  ▁ab▁  thein\n\t0é中國ｱ\0<s>ering  ----====    "
    known = list(model.id)
    mixed = lambda n: "".join(rng.choice(known) for _ in range(n))
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)] + [c * k for c in " -a▁" for k in range(40)]
    out += [mixed(rng.randrange(1, 9)) for _ in range(1500)] + [mixed(rng.randrange(1, 9)).replace("▁", " ") for _ in range(1500)] + [mixed(3000), "ab" * 5000]
    return out + ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(300)]


def test_pieces_equal_the_library(spark):
    model = pieces.piece_model(MODEL)
    texts = hard_texts(model, random.Random(3))
    buf, off = kernels.strings_bytes(texts)
    ids, per = model.encode_slice(buf, off)
    got = [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])]
    wanted = model.processor.encode(texts)
    assert got == wanted
    # without cuts, a text as one chunk
    assert [model.encode("▁" + t.replace(" ", "▁")) for t in texts[:400] if t] == [w for t, w in zip(texts[:400], wanted[:400], strict=True) if t]


def test_bytes_that_are_not_utf8():
    model = pieces.piece_model(MODEL)
    raw = [b"a\xff b", b"", b"plain", b"\xe4\xb8"]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    ids, per = model.encode_slice(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == model.processor.encode([x.decode("utf-8", "replace") for x in raw])


def test_pieces_of_rows(spark):
    texts = [None, "", " ", "Hello  world\n", "Hello  world\n", "▁x é 中 \U0001f600", "word " * 30_000, "x" * 100_000]
    df = spark.createDataFrame([(i // 2 or None, t, "en", 1.0, "w") for i, t in enumerate(texts)], DOCS).withColumn("ids", F.lit("other")).repartition(3)
    library = pieces.piece_model(MODEL).processor
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = []
    for i, t in enumerate(texts):
        ids = [*library.encode(t or ""), library.eos_id()]
        wanted.append((i // 2 or None, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, pieces.round_trip(df, MODEL).collect()), key=key) == sorted(wanted, key=key)
    both = pieces.decode(pieces.encode(df, MODEL), MODEL)
    assert both.columns == ["doc_id", "text", "lang", "score", "word", "ids", "decoded"]
    assert all((r["text"] or "") == r["decoded"] for r in both.collect() if "▁" not in (r["text"] or ""))
    assert pieces.round_trip(df.limit(0), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).first()["decoded"] is None


VECTORS = "vec_id bigint, embedding array<float>, v string, label int"


def test_remainders_give_back_numbers():
    for value in (0, 1, -1, 10**30, -(10**30) - 7):
        primes = whitening.primes_above(2 * abs(value) + 2)
        assert whitening.remaindered([value % p for p in primes], primes) == value


def test_whitening_equals_fractions(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 6)).astype(np.float32) * [3, 2, 1, 0.5, 0.3, 2000]
    data[:, 5] += 1e6  # far from the origin
    vectors = [[float(np.float32(c)) for c in row] for row in data]
    rows = [(i, x, "x", 1) for i, x in enumerate(vectors)]
    rows += [(1000, None, "", 0), (1001, [1.0, None] + [1.0] * 4, "", 0), (1002, [1.0, float("nan")] + [1.0] * 4, "", 0), (1003, [float("-inf")] + [1.0] * 5, "", 0), (1004, [], "", 0), (1005, [1.0] * 5, "", 0)]
    rows += [(5, vectors[5], "", 0), (None, vectors[6], None, None)]
    used = [(i, x) for i, x, *_ in rows if x and len(x) == 6 and all(c is not None and math.isfinite(c) for c in x)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in used]
    n, d = len(x), 6
    total = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - total[j] for j in range(d)] for r in x]
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    wanted = np.array(centred, float) / n @ axes / np.sqrt(values)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(4)).toPandas()
    assert len(got) == n * d and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-4
    assert set(got["vec_id"].dropna()) == {i for i, _ in used if i is not None}
    deviation = {i: sum(c * c for c in r) for (i, _), r in zip(used, centred, strict=True)}
    for i, r in enumerate(wanted):
        own = got[got["vec_id"] == used[i][0]] if used[i][0] is not None else got[got["vec_id"].isna()]
        own = own.sort_values("component").drop_duplicates("component")
        assert (own["deviation"] == deviation[used[i][0]]).all()
        assert np.allclose(np.abs(own["whitened"]), np.abs(r), rtol=1e-6, atol=1e-6)
        assert np.allclose(own["explained"], values / np.trace(covariance), rtol=1e-6)
    # one sign a component
    signs = np.sign(got.pivot_table(index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy() * wanted[:300])
    assert (np.abs(signs.sum(0)) == 300).all()


def test_whitening_without_variance(spark):
    frame = lambda *v: spark.createDataFrame([(i, x, "", 0) for i, x in enumerate(v)], VECTORS)
    assert whitening.whiten(frame([1.0, 2.0], [1.0, 2.0])).count() == 0
    assert whitening.whiten(frame([1.0, 2.0])).count() == 0
    assert whitening.whiten(frame([1.0, 2.0]).limit(0)).count() == 0
    assert {r["component"] for r in whitening.whiten(frame([1.0, 2.0], [3.0, 2.0], [1.5, 2.0])).collect()} == {1}
    with pytest.raises(ValueError):
        whitening.whiten(frame([1e30, 2.0], [3.0, 2.0]))


def test_sums_beyond_longs(spark):
    assert whitening._exact(10, [5, 6], 100).dtype == np.int64
    assert whitening._exact(10**9, [5, 6], 10**6).dtype == object
    centred, _ = whitening._projected(np.array([[10**14, 1]]), 10**6, np.array([10**20, 0], object), np.eye(2))
    assert centred.tolist() == [[0, 10**6]]
