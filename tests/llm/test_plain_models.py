"""Language profiles and the quality classifier held against plain versions, text by text and update by update."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexiloom.llm import kernels as K
from lexiloom.llm import langid, quality


# language profiles


def letter(ch):
    if not ch.isalpha():
        return 0
    return ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch)


def vector(code):
    return np.random.default_rng(code).integers(0, 2, langid.DIMENSIONS, dtype=np.int8).astype(float) * 2 - 1


def profile(text):
    codes = [0, *map(letter, text or ""), 0]
    total = np.zeros(langid.DIMENSIONS)
    for left, middle, right in zip(codes, codes[1:], codes[2:], strict=False):
        if middle:
            total += np.roll(vector(left), 2) * np.roll(vector(middle), 1) * vector(right)
    return total


def unit(x):
    return x / max(np.linalg.norm(x), 1e-12)


def test_languages_by_plain_profiles(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "абвгдежß", "dd": "İÉé中文字ab"}
    word = lambda letters: "".join(rng.choices(letters, weights=range(1, len(letters) + 1), k=rng.randint(1, 7)))
    text = lambda letters: rng.choice(["", "12, "]) + rng.choice([" ", "--", "\n\n"]).join(word(letters) for _ in range(rng.randint(1, 12)))
    rows = [(k, text(alphabets[lang := rng.choice(sorted(alphabets))]), lang) for k in range(150)]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 --", "cc"), (203, "abc", None), (7, rows[7][1].upper(), "aa"), (None, "abcd efgh", "dd")]
    learned = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for d, t, lang in rows:
        if d is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1 and any(map(letter, t or "")):
            learned[lang] += profile(t)
    langs = sorted(learned)
    mean = np.mean([unit(learned[x]) for x in langs], axis=0)
    proto = [unit(unit(learned[x]) - mean) for x in langs]
    expected = {}
    for d, t, _ in rows:
        if any(map(letter, t or "")):
            cosine = [float(p @ unit(unit(profile(t)) - mean)) for p in proto]
            expected[d, t] = (langs[int(np.argmax(cosine))], min(1.0, max(0.0, (1 + max(cosine)) / 2)))
        else:
            expected[d, t] = ("und", 0.0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labelled = docs.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 != 1").select("text", "lang")
    got = langid.predict_languages(docs.select("doc_id", "text"), labelled, keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = expected[r.doc_id, r.text]
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4)
    by_id = {r.doc_id: r for r in langid.identify(docs.where("doc_id != 7")).collect()}
    assert all(by_id[d].lang_pred == expected[d, t][0] and by_id[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, t, _ in rows if d not in (7, None))


# quality


def one_hash(token):
    buf = np.frombuffer(token, np.uint8)
    return int(K.span_hash(K.prefix_hash(buf), np.array([0]), np.array([len(buf)]))[0])


def plain_features(text):
    """{feature: share}: tokens and pairs of neighbours, one shared feature for a pair of equals."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    # bytes of characters beyond ASCII count as letters
    tokens = [one_hash(t) for t in re.findall(rb"[0-9a-z\x80-\xff]+|[\x21-\x2f\x3a-\x60\x7b-\x7e]+", low)]
    with np.errstate(over="ignore"):
        pairs = [1 if a == b else int(K.mix(np.array([a], np.uint64) * np.uint64(3) + np.array([b], np.uint64))[0]) for a, b in zip(tokens, tokens[1:], strict=False)]
    every = Counter(x & ((1 << quality.BITS) - 1) for x in tokens + pairs)
    return {k: n / sum(every.values()) for k, n in every.items()}


class PlainFtrl:
    def __init__(self):
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, i):
        if abs(self.z[i]) <= quality.L1:
            return 0.0
        return -(self.z[i] - math.copysign(quality.L1, self.z[i])) / ((quality.BETA + math.sqrt(self.n[i])) / quality.ALPHA + quality.L2)

    def score(self, x):
        margin = sum(self.weight(i) * v for i, v in x.items())
        return 1 / (1 + math.exp(-max(-30, min(30, margin))))

    def learn(self, x, label):
        error = self.score(x) - label
        old = {i: self.weight(i) for i in x}
        for i, v in x.items():
            g = error * v
            self.z[i] += g - (math.sqrt(self.n[i] + g * g) - math.sqrt(self.n[i])) / quality.ALPHA * old[i]
            self.n[i] += g * g


def test_quality_by_plain_updates(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    good, bad = ["river", "Stone", "évora", "walks", ",", "slowly"], ["BUY", "now", "!!!", "now", "$$$", "click"]
    text = lambda label: " ".join(rng.choice((good if label else bad) if rng.random() < 0.7 else good + bad) for _ in range(rng.randint(1, 30)))
    rows, labels = [], []
    for k in range(120):
        label = rng.randint(0, 1)
        rows.append((k, text(label)))
        labels.append((k, label))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "x")]
    labels += [(200, 1), (201, 0), (203, None), (None, 1), (300, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    example = lambda t: {**{i: v * quality.SCALE for i, v in plain_features(t).items()}, "bias": 1.0}
    texts = dict(rows)
    known = [(hashes[d], example(texts[d]), y) for d, y in labels if d in texts and y is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    model = PlainFtrl()
    for _ in range(quality.EPOCHS):
        for _, x, y in sorted(known, key=lambda e: e[0]):
            model.learn(x, y)
    got = {r.doc_id: r for r in quality.score_quality(docs, given).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        assert got[d].score == pytest.approx(model.score(example(t)), abs=1e-4)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and got[d].predicted == (got[d].score >= quality.THRESHOLD)
    assert max(r.score for r in got.values()) - min(r.score for r in got.values()) > 0.3
