"""License scans with whole license texts, held against a plain reading of every stretch."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import licenses


def sentence(rng, n, vocabulary=9000):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def plain(docs, templates):
    """(doc_id, license, share, first_word, n_places) by counting along each text."""
    found = []
    for d, text in docs:
        places = shingles(text)
        for name, body in templates.items():
            own = set(shingles(body))
            reach, best, starts = math.ceil(len(shingles(body)) * licenses.ROOM), (0, 0), 0
            window, end = Counter(), 0
            for p, s in enumerate(places):
                while end < min(p + reach, len(places)):
                    if places[end] in own:
                        window[places[end]] += 1
                    end += 1
                if s in own:
                    share = len(window) / len(own)
                    if share >= licenses.CONTAINED:
                        starts += 1
                        best = max(best, (share, -p))
                    window[s] -= 1
                    if not window[s]:
                        del window[s]
            if starts:
                found.append((d, name, round(best[0], 9), -best[1], starts))
    return sorted(found)


def scanned(df, templates):
    return sorted((r.doc_id, r.license, round(r.share, 9), r.first_word, r.n_places) for r in licenses.scan_licenses(df, templates).collect())


def edited(rng, text, share):
    words = text.split()
    for k in rng.sample(range(len(words)), int(len(words) * share)):
        words[k] = rng.choice(["", words[k] + " added", f"x{rng.randrange(99)}"])
    return " ".join(words)


@pytest.mark.parametrize("literal", [10_000, 0])
def test_edited_templates_of_all_lengths(spark, monkeypatch, literal):
    monkeypatch.setattr(licenses, "LITERAL_KEYS", literal)
    rng = random.Random(5)
    templates = {f"L{n}": sentence(rng, n) for n in (5, 6, 8, 9, 20, 60, 200, 600)}
    # templates that repeat themselves, and that share their beginning
    templates["twice"] = " ".join([sentence(rng, 40)] * 2)
    templates["longer"] = templates["L60"] + " " + sentence(rng, 15)
    docs = []
    for k in range(60):
        names = rng.choices(sorted(templates), k=rng.randint(0, 4))
        parts = [edited(rng, templates[n], rng.choice([0, 0, 0.01, 0.03])) for n in names]
        docs.append((k % 50, sentence(rng, rng.randint(0, 80)) + " " + f" {sentence(rng, rng.choice([0, 3, 400]))} ".join(parts)))
    docs += [(90, None), (91, ""), (92, " ".join([templates["L20"]] * 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = scanned(df, templates)
    assert got == plain(docs, templates) and len(got) > 60


def test_whole_licenses_in_a_large_library(spark):
    """50 texts of 5,000 words: keys and shingles are joined, one document in three holds the same license."""
    rng = random.Random(6)
    templates = {f"L{n}": sentence(rng, 5000) for n in range(50)}
    docs = []
    for k in range(100):
        name = "L0" if k % 3 == 0 else f"L{k % 50}"
        docs.append((k, " ".join([sentence(rng, 300), edited(rng, templates[name], 0.01 if k % 2 else 0), sentence(rng, 200)])))
    docs.append((100, " ".join(templates["L7"].split()[:3000])))
    library = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = scanned(df, library)
    assert got == plain(docs, templates) and len(got) == 100


def test_libraries_as_tables(spark):
    """Variants share a license's name; nulls and short texts match nothing."""
    old, new = sentence(random.Random(7), 30), sentence(random.Random(8), 30)
    library = spark.createDataFrame([("A", old), ("A", new), ("A", new), ("B", None), (None, old), ("C", "four words are few")], "license string, text string")
    df = spark.createDataFrame([(1, old), (2, new + " " + old), (3, "four words are few")], "doc_id long, text string").withColumn("license", F.lit("x")).withColumn("row", F.lit(1))
    assert sorted(tuple(r) for r in licenses.scan_licenses(df, library).select("doc_id", "license", "share", "first_word").collect()) == [(1, "A", 1.0, 0), (2, "A", 1.0, 0)]
    assert licenses.scan_licenses(df, library.where("false")).count() == 0
