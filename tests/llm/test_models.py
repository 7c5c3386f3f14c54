"""Operators held against brute force, round trips or held-out accuracy."""

import html
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import ann, components, htmltext, langid, licenses, packing, passagededup, quality, queries

from . import brute

SMALL = "/root/testdata/sf0.01"
PATH = queries.tokenizer_path()


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, source string, seg long")


def sentence(rng, n, vocabulary=9000):
    return " ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(vocabulary)}" for _ in range(n))


# packing


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.randint(1, 700))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "<|endoftext|> a\n\n b <|endoftext|>"), (63, "it's 12 é　x 日本 🙂\t \n"), (64, sentence(rng, 9000)), (0, rows[0][1])]
    got = packing.pack_documents(docs_of(spark, rows), PATH).collect()
    plain = Tokenizer.from_file(PATH)
    expected = []
    for d, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (start, length) in enumerate(packing.pieces_of(len(ids), 2048)):
            expected.append((d, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got) == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 2048 * 1.05 + 2


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n\t'sß🙂  12.,日<|>") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    plain = Tokenizer.from_file(PATH)
    assert [list(x) for x in packing.tokens_of(pa.array(texts), PATH)] == [[*e.ids, 0] for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_best_two_fit_replaces_the_smallest():
    plan = packing.best_two_fit({7: 1, 2: 1, 1: 0, 6: 0}, 10)
    assert sorted(x for n, fill in plan for x in fill * n) == [2, 7]
    # greedy takes 6 and 3 (gap 1); 2 + 2 fill the gap of 4
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    rng = random.Random(1)
    counts = {n: rng.randint(0, 50) for n in range(1, 101)}
    plan = packing.best_two_fit(counts, 100)
    packed = {}
    for times, fill in plan:
        assert sum(fill) <= 100
        for x in fill:
            packed[x] = packed.get(x, 0) + times
    assert packed == {k: v for k, v in counts.items() if v}
    assert sum(t for t, _ in plan) <= sum(k * v for k, v in counts.items()) / 100 * 1.04 + 1


def test_packing_with_ids_round_trips(spark):
    from tokenizers import Tokenizer

    rows = [(1, "Hello there,  you."), (2, None), (3, sentence(random.Random(1), 1500))]
    got = packing.pack_documents(docs_of(spark, rows), PATH, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    for d, t in rows:
        ids = [i for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece) for i in r.ids]
        assert plain.decode(ids[:-1]) == (t or "") and ids[-1] == 0


# language and quality


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(truth)
    out = [d for d, r in got.items() if r.held_out]
    assert set(out) == {d for d in truth if brute.crc_fold(d, 3) == 1}
    assert np.mean([got[d].lang_pred == truth[d] for d in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog sat there", "en"), (2, "der hund und die katze sitzen", "de"), (3, None, "en"), (4, "12 !?", None), (5, "", "xx"), (None, "the dog", "en"), (7, "the", None), (8, "Ж日本", None), (9, "x" * 5000, None)]
    docs = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, text string, lang string, score string")
    labelled = docs.where("doc_id < 3").select("text", "lang")
    got = {r.doc_id: r for r in langid.predict_languages(docs.drop("lang"), labelled).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, None, 7)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert got[3].score == 0
    nothing = langid.predict_languages(docs, labelled.where("false")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(rows)
    assert langid.identify(docs.where("false")).count() == 0


def test_long_texts_are_read_in_pieces():
    import tracemalloc
    from collections import Counter

    rng = random.Random(6)
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0x4E00, 0x4E40), 0x20, 0x2E, 0xE9, 0x1F600)]
    text = "".join(rng.choices(letters, k=2_500_000))
    buf, off = langid.K.strings_bytes(["short", text, "end"])

    def counted(pieces):
        total, n = Counter(), 0
        for i, j, three, of, doc, letters, _ in pieces:
            n += int(letters.sum())
            for k, times in zip(*np.unique(of, return_counts=True), strict=True):
                total[tuple(three[k].tolist())] += int(times)
        return total, n

    whole = langid._trigrams(buf, off)
    assert len(list(langid._pieces(buf, off))) > 3
    assert counted(langid._pieces(buf, off)) == counted([(0, 3, *whole, True)])
    batch = pa.record_batch({"text": pa.array(["".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 1_500_000)))])})
    model = type("B", (), {"value": (["a", "b"], np.ones((2, langid.DIMENSIONS), np.float32), np.zeros(langid.DIMENSIONS, np.float32))})
    tracemalloc.start()
    out = next(langid._predict_batches(model, False)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert out.column(2).to_pylist() == [1_500_000]


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    out = [d for d in truth if brute.crc_fold(d, 4) == 2]
    assert all(got[d].held_out for d in out)
    good = np.array([got[d].score for d in out if truth[d] == 1])
    bad = np.array([got[d].score for d in out if truth[d] == 0])
    assert (good[:, None] > bad).mean() > 0.97
    assert np.mean([got[d].predicted == truth[d] for d in out]) > 0.93


def test_quality_edge_cases(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (3, "good words"), (3, "good words"), (None, "###"), (5, "a " * 20000)])
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1), (5, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}


# neighbours


def nearest(ids, matrix, queries_, top):
    out = {}
    for q in queries_:
        own = np.flatnonzero(ids == q)[0]
        scores = matrix @ matrix[own]
        out[q] = [(int(ids[i]), scores[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:top]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((12, 64))
    matrix = (centers[rng.integers(0, 12, 4000)] + 0.6 * rng.standard_normal((4000, 64))).astype(np.float32)
    matrix[100:700] = matrix[100]
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(rows, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    truth = nearest(np.arange(4000), matrix.astype(float), range(0, 4000, 20), 20)
    assert set(got) == set(truth)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        floor = truth[q][-1][1] - 1e-9
        hits += sum(s >= floor for _, _, s in found)
    assert hits / (20 * len(truth)) >= 0.9


def test_neighbours_edge_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (40, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (2, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 2, 0.5)]
    assert ann.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


# pages


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for page in pages.collect():
        article = re.sub(r"<!--.*?-->", "", re.search(r"<article>(.*)</article>", page.html, re.S)[1], flags=re.S)
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        text = "\n".join(x for x in blocks if x)
        assert got[page.page_id].text == text and got[page.page_id].n_chars == len(text)


def test_page_edge_cases(spark):
    shell = "<html><head><title>T</title><script>if (a<b) x='</p>'</script></head><body><header>Top</header><div id='menu'><a>Home</a></div><div class='post'><h1>H {0}</h1><p>One &amp; two {0}<p>Three  <b>bold</b>\n{0}</div><section class='comments'><p>Nice {0}!</p></section><div class='cookie-notice'>OK</div><form>Mail <input></form><footer>&copy; F</footer></body></html>"
    rows = [(k, f"https://a.example/{k}", shell.format(k), "s") for k in range(8)]
    rows += [(20, None, None, "s"), (21, "not a url", "", "s"), (22, "https://b.example/", "<p>Alone &lt;x&gt; 3 < 4", "s"), (22, "https://b.example/", "<p>Alone &lt;x&gt; 3 < 4", "s"), (23, "https://a.example/z", "<body><table><tr><td>Cell</table>", "s"), (None, "https://a.example/y", "plain", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, slot string")
    got = {r.page_id: r.text for r in htmltext.extract_pages(df).collect()}
    for k in range(8):
        assert got[k] == f"H {k}\nOne & two {k}\nThree bold {k}"
    assert [got[k] for k in (20, 21, 22, 23, None)] == ["", "", "Alone <x> 3 < 4", "Cell", "plain"]
    assert htmltext.extract_pages(df).count() == len(rows)
    assert htmltext.extract_pages(df.where("false")).count() == 0


# licenses


@pytest.mark.parametrize("literal", [10_000, 0])
def test_licenses_against_sql(spark, monkeypatch, literal):
    monkeypatch.setattr(licenses, "LITERAL_KEYS", literal)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((r.doc_id, r.license, round(r.share, 9)) for r in licenses.scan_licenses(docs).collect())
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    expected = sorted((d, k, round(s, 9)) for d, k, s in base.sql(licenses.oracle_sql()).fetchall())
    assert got == expected and len(got) > 10


def test_license_edge_cases(spark):
    full = licenses.TEMPLATES["Apache-2.0-text"]
    changed = full.replace("required by", "demanded by")
    rows = [(1, None), (2, ""), (3, "mit license"), (4, "RELEASED under the MIT license!"), (4, "RELEASED under the MIT license!"), (5, f"intro words {full} tail"), (6, changed), (7, " ".join(full.split()[:10])), (8, sentence(random.Random(1), 3000) + " " + full)]
    got = sorted((r.doc_id, r.license) for r in licenses.scan_licenses(docs_of(spark, rows)).collect())
    assert got == [(4, "MIT"), (4, "MIT"), (5, "Apache-2.0-text"), (6, "Apache-2.0-text"), (8, "Apache-2.0-text")]
    assert licenses.scan_licenses(docs_of(spark, [])).count() == 0


# passages


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(9)
    shared, other = sentence(rng, 80), sentence(rng, 120)
    edited = other.split()
    edited[60] = "changed"
    rows = [(k, sentence(rng, 150)) for k in range(20)]
    rows += [(30, f"{sentence(rng, 40)} {shared} {sentence(rng, 30)}"), (31, f"{sentence(rng, 70)} {shared}"), (32, f"{shared.upper()} {sentence(rng, 90)}")]
    rows += [(40, f"{sentence(rng, 25)} {other}"), (41, f"{' '.join(edited)} {sentence(rng, 60)}")]
    rows += [(50, sentence(rng, 30)), (51, None), (52, ""), (60, rows[3][1]), (60, rows[3][1]), (70, f"{sentence(rng, 20)} {' '.join(shared.split()[:40])} {sentence(rng, 40)}")]
    return rows


def test_passages(spark, passages):
    got = {}
    for r in passagededup.dedup_passages(docs_of(spark, passages)).collect():
        got.setdefault(r.doc_id, []).append(r)
    one = {d: r[0] for d, r in got.items()}
    assert sum(map(len, got.values())) == len(passages)
    assert {one[k].class_id for k in (30, 31, 32)} == {30} and {one[k].class_id for k in (40, 41)} == {40}
    assert [one[k].n_removed for k in (30, 31, 32)] == [0, 80, 80] and [one[k].n_near for k in (30, 31, 32)] == [80, 80, 80]
    assert one[40].n_removed == 0 and 110 <= one[41].n_removed <= 121
    assert all(one[k].n_near == 0 for k in (0, 1, 2, 4, 50, 51, 52, 70))
    assert [r.n_removed for r in got[60]] == [150, 150] and one[3].n_removed == 0 and one[3].n_links == 1


def test_passages_are_cut_from_texts(spark, passages):
    got = {}
    for r in passagededup.remove_passages(docs_of(spark, passages)).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = {d: t for d, t in passages}
    assert got[51][0].text is None and got[52][0].text == "" and got[0][0].text == texts[0] and got[30][0].text == texts[30]
    assert got[31][0].text.strip() == " ".join(texts[31].split()[:70]) and got[32][0].text == " ".join(texts[32].split()[80:])
    assert [r.text for r in got[60]] == ["", ""] and got[3][0].text == texts[3]
    assert {r.source for rows in got.values() for r in rows} == {"x"}
    assert passagededup.remove_passages(docs_of(spark, [])).count() == 0


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(1)
    values, count, width, seed = rng.integers(0, 2**64, 300, dtype=np.uint64), np.array([0, 120, 3, 177]), 12, 77
    values[50:60] = values[40:50]
    doc, left, at, right, least = passagededup.compact_windows(values, count, width, seed)
    h = passagededup.K.mix(values ^ np.uint64(seed))
    order = (h >> np.uint64(32)) | np.uint64(1)
    first = np.cumsum(count) - count
    for d, n in enumerate(count):
        own, rank = h[first[d] : first[d] + n], order[first[d] : first[d] + n]
        for i in range(n - width + 1):
            for j in range(i + width - 1, n):
                low = own[i + int(rank[i : j + 1].argmin())]
                assert ((doc == d) & (left <= i) & (at >= i) & (at <= j) & (right >= j) & (least == low)).sum() == 1


# components and pipeline


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000, k) for k in range(1001, 1100)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (None, 6)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    local = [(r.doc_id, r.text) for r in docs.collect()]
    kept = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept}
        kept = stage(spark, spark.createDataFrame(kept, docs.schema), brute.SF).collect()
        assert list(kept[0].__fields__) == columns, name
        assert {r.doc_id for r in kept} <= set(before)
        if name == "language_id":
            assert len(kept) == len(before)
        if name == "simhash_dedup":
            assert {r.doc_id for r in kept} == {c for _, _, c in brute.near(local)}
        if name == "substring_dedup":
            assert len(kept) == len(before) and all(r.n_chars == len(r.text) for r in kept)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
            clean = {d for d, *_, bad in brute.contaminated([(r.doc_id, r.text) for r in before.values()], items) if not bad}
            assert {r.doc_id for r in kept} == clean
    packed = corpus_pipeline.run(spark, brute.SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept}


def test_language_stage_drops_only_what_is_no_language(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 --- 777", "en", "s", 13), (9002, None, None, "s", 0), (9003, "Oui.", "fr", "s", 4)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(extra), brute.SF).collect()}
    assert 9003 in kept and not kept & {9001, 9002} and len(kept) == docs.count() + 1


def test_lists_are_fitted_piece_by_piece(monkeypatch):
    """Distances come in pieces of bounded size; the lists don't depend on it, and none is lost to repeated vectors."""
    rng = np.random.default_rng(3)
    sample = np.concatenate([rng.normal(size=(900, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0)])
    whole = ann.fit_centroids(sample, 40)
    monkeypatch.setattr(ann, "CELLS", 70)
    assert np.allclose(ann.fit_centroids(sample, 40), whole) and whole.shape == (40, 8) and np.isfinite(whole).all()
    centers = ann.fit_centroids(sample, 40, rounds=1)
    rng = np.random.default_rng(ann.SEED)
    start = sample[rng.choice(len(sample), 40, replace=False)]
    near = ((sample[:, None] - start[None]) ** 2).sum(2).argmin(1)
    for k in np.unique(near):
        assert np.allclose(centers[k], sample[near == k].mean(0))
