"""License scans with DataFrame and SQL functions only.

Texts become words, words become five-word shingles, and overlapping windows of
shingles are reduced to MinHash values, one per band. Windows of the license
templates are reduced in the same way; a document's window that shares a band with
a template's window retrieves the template, and the exact share of the template's
shingles in the text around the window decides.

Bands: a window has WINDOW shingles and starts at every shingle; a band is one
MinHash value. In a text that holds 0.8 of a template's shingles the missing ones
come in blocks of four or more (a changed word takes five, an inserted one four),
so some block of WINDOW or more neighbouring shingles is whole, its window equals
the template's, and all bands meet: the collision probability is 1. Templates of
fewer shingles than WINDOW have windows of their own length. A window of Jaccard
similarity J that isn't whole still meets with probability 1 - (1 - J)^BANDS.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.

In the scan the keys of a small library are literals. Of a larger one a bitmap, with
many times more bits than there are keys, tells which windows can have a template's
key. Documents that have such windows are cut to stretches around them, which are
stored: every window is in one stretch, and no word is in two.

Verification is linear in the text. The shingles of the places that a template may
reach are joined with the library's shingles, by hash and then by their words. A
shingle at q that was last seen at p counts once for the stretches of length n that
start after max(p, q - n) and not after q, so the number of different shingles in
each stretch is a running sum over the starts and ends of such intervals.

Defined results: null and empty texts, and texts of fewer than five words, match no
template; equal rows are answered one by one; further columns are ignored. Several
texts of one license are variants of it, and the best counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialise

SHINGLE = 5
WINDOW = 4
BANDS = 2
CONTAINED = 0.8
#: Words between two shingles of a match: room for insertions.
ROOM = 1.25
#: Up to how many keys they are literals of the scan, and up to how many their table is broadcast.
LITERAL_KEYS, BROADCAST_KEYS = 10_000, 200_000
#: Least bits of the bitmap, bits for a key, and most bits (4 MB; with more keys more windows are joined in vain).
BITS, BITS_A_KEY, MOST_BITS = 1 << 20, 64, 1 << 25
#: Bits of the bitmap that each key sets.
PROBES = 3

# Short public notices and the opening sentences of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(F.regexp_replace(F.coalesce(ascii_lower, F.lit("")), NOT_WORD, " "), " "), lambda w: w != "")


def shingle_hashes(tokens: str) -> Column:
    """A hash for each shingle of the words in a column; an empty array for fewer than SHINGLE words."""
    each = lambda i: F.xxhash64(*(F.get(F.col(tokens), i + k) for k in range(SHINGLE)))
    return F.when(F.size(tokens) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(tokens) - SHINGLE), each)).otherwise(F.array().cast("array<bigint>"))


def banded(hashes: str, band: int) -> Column:
    """The shingle hashes under a band's hash function; band 0 takes them as they are."""
    return F.col(hashes) if band == 0 else F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band)))


def window_minima(hashes: str, width: int) -> Column:
    """(place, MinHash) of every window of width shingles."""
    place = F.sequence(F.lit(0), F.size(hashes) - width)
    return F.when(F.size(hashes) >= width, F.transform(place, lambda i: F.struct(i.alias("at"), F.array_min(F.slice(F.col(hashes), i + 1, width)).alias("key"))))


def bit_of(key: Column, probe: int, bits: int) -> Column:
    return (key if probe == 0 else F.xxhash64(key, F.lit(-probe))).bitwiseAND(F.lit(bits - 1))


def in_bitmap(bitmap: Column, bits: int):
    """Whether all bits of a key are in the bitmap, as a function of the key."""

    def one(bit):
        return F.get(bitmap, F.shiftright(bit, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)).cast("int"))) != 0

    return lambda key: reduce(Column.__and__, (one(bit_of(key, probe, bits)) for probe in range(PROBES)))


def window_hits(hashes: Column, width: int, band: int, seen) -> Column:
    """Windows of a document whose MinHash may be a template's: (at, width, band, key)."""

    def key(i):
        each = [F.get(hashes, i + k) for k in range(width)]
        return F.least(*each) if width > 1 else each[0]

    places = F.filter(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: seen(key(i)))
    places = F.when(F.size(hashes) >= width, places).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(width).alias("width"), F.lit(band).alias("band"), key(i).alias("key")))


def let(value: Column, body) -> Column:
    """body of the value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def stretches_of(hits: Column, far: int) -> Column:
    """Hits in parts more than far places apart: an array of (low, high, hits), low and high their first and last place."""

    def parts(h):
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i)["at"] - F.get(h, i - 1)["at"] > far))
        return let(starts, lambda s: F.transform(s, lambda first, k: part(h, first, F.coalesce(F.get(s, k + 1), F.size(h)))))

    def part(h, first, end):
        return F.struct(F.get(h, first)["at"].alias("low"), F.get(h, end - 1)["at"].alias("high"), F.slice(h, first + 1, end - first).alias("hits"))

    return let(F.array_sort(hits), lambda h: F.when(F.size(h) > 0, parts(h)))


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """Templates of five words and more: (t, license, words, hashes), t their number."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(sorted(templates.items()), "license string, text string")
    rows = rows.select("license", F.col("text").cast("string").alias("text")).where("license is not null").distinct()
    tokens = rows.select(F.monotonically_increasing_id().alias("t"), "license", words(F.col("text")).alias("words"))
    return materialise(tokens.withColumn("hashes", shingle_hashes("words"))).where(F.size("hashes") > 0)


def template_shingles(library: DataFrame) -> DataFrame:
    """The different shingles of each template: (t, hash, shingle)."""
    each = F.transform("hashes", lambda h, i: F.struct(h.alias("hash"), F.array_join(F.slice("words", i + 1, SHINGLE), " ").alias("shingle")))
    return library.select("t", F.explode(F.array_distinct(each)).alias("s")).select("t", "s.hash", "s.shingle")


def template_keys(templates: DataFrame) -> DataFrame:
    """(width, band, key, t) of every window of every template: a table of the template library's size."""
    parts = []
    for band in range(BANDS):
        # a window shorter than WINDOW is a whole template: it is there or not, one band tells
        base = templates.select("t", banded("hashes", band).alias("hashes"), F.least(F.size("hashes"), F.lit(WINDOW)).alias("width"))
        for width in range(1 if band == 0 else WINDOW, WINDOW + 1):
            own = base.where(F.col("width") == width).select("t", F.lit(width).alias("width"), F.lit(band).alias("band"), F.explode(window_minima("hashes", width)).alias("w"))
            parts.append(own.select("width", "band", F.col("w.key").alias("key"), "t"))
    return reduce(DataFrame.unionByName, parts).distinct()


def key_bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """One row with an array of bits, in numbers of 64, that holds the bits of all keys."""
    own = keys.select(F.explode(F.array(*(bit_of(F.col("key"), probe, bits) for probe in range(PROBES)))).alias("bit")).distinct()
    numbers = own.groupBy(F.shiftright("bit", 6).cast("int").alias("no")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("number"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("no"))
    filled = every.join(numbers, "no", "left").select("no", F.coalesce("number", F.lit(0)).alias("number"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "number"))), lambda x: x["number"]).alias("bitmap"))


def suspect_stretches(documents: DataFrame, keys: DataFrame, longest: int, id_col: str, text_col: str) -> DataFrame:
    """The parts of documents around windows that may be a template's: (row, doc_id, base, words, hits), base the place of the first word."""
    groups = sorted(tuple(r) for r in keys.select("width", "band").distinct().collect())  # at most WINDOW + BANDS
    n_keys = keys.count()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), words(F.col(text_col).cast("string")).alias("words"))
    rows = rows.withColumn("h0", shingle_hashes("words"))
    for band in range(1, BANDS):
        rows = rows.withColumn(f"h{band}", banded("h0", band))
    if n_keys <= LITERAL_KEYS:
        each = {g: sorted(r["key"] for r in keys.where((F.col("width") == g[0]) & (F.col("band") == g[1])).select("key").distinct().collect()) for g in groups}
        seen = {g: (lambda key, own=own: key.isin(own)) for g, own in each.items()}
    else:
        # one row of bounded size
        bits = min(MOST_BITS, max(BITS, 1 << (BITS_A_KEY * n_keys).bit_length()))
        rows = rows.crossJoin(F.broadcast(key_bitmap(keys, bits)))
        seen = dict.fromkeys(groups, in_bitmap(F.col("bitmap"), bits))
    hits = F.concat(*(window_hits(F.col(f"h{band}"), width, band, seen[width, band]) for width, band in groups)) if groups else F.array().cast("array<struct<at:int,width:int,band:int,key:bigint>>")
    # a template's own place is unknown: look as far as the longest reaches to either side
    far, tail = int(longest * ROOM + 1), SHINGLE + WINDOW
    # explode_outer: no filter on the array is inferred, which would compute it twice
    part = rows.select("row", "doc_id", "words", F.explode_outer(stretches_of(hits, 2 * far + tail)).alias("part")).where("part is not null")
    base = F.greatest(F.col("part.low") - far, F.lit(0))
    return part.select("row", "doc_id", base.alias("base"), F.slice("words", base + 1, F.col("part.high") + far + tail - base).alias("words"), F.col("part.hits").alias("hits"))


def scan_licenses(documents: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found in it: doc_id, license, share, first_word, n_places.

    share is the largest share of a text of the license whose shingles stand together in the document, first_word
    the first place where such a stretch starts, and n_places the number of places where a stretch starts that
    holds at least CONTAINED of the text.

    The template library is a parameter, as a dictionary or as a table (license, text) of any size; its tables of
    window keys and shingles are broadcast behind a check of their size, else joined.
    """
    spark = documents.sparkSession
    library = template_table(spark, TEMPLATES if templates is None else templates)
    keys, shingles = materialise(template_keys(library)), materialise(template_shingles(library))
    sizes = shingles.groupBy("t").agg(F.count(F.lit(1)).alias("own"))
    facts = library.select("t", "license", F.ceil(F.size("hashes") * F.lit(ROOM)).cast("int").alias("reach")).join(sizes, "t")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    longest = library.agg(F.max(F.size("hashes"))).first()[0] or 0
    stretches = materialise(suspect_stretches(documents, keys, longest, id_col, text_col))

    hits = stretches.select("row", "base", F.explode("hits").alias("hit")).select("row", "base", "hit.*")
    hits = hits.join(small(keys), ["width", "band", "key"]).join(small(facts), "t").select("row", "base", "at", "t", "license", "reach", "own")
    retrieved = materialise(hits.distinct())
    # the places that a template found there can reach, put together where they meet
    span = retrieved.select("row", "base", F.greatest(F.col("at") - F.col("reach"), F.col("base")).alias("low"), (F.col("at") + F.col("reach") + WINDOW).alias("high")).distinct()
    before = Window.partitionBy("row", "base").orderBy("low", "high")
    span = span.withColumn("reached", F.max("high").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    span = span.withColumn("part", F.sum(F.when(F.col("low") <= F.col("reached") + 1, 0).otherwise(1)).over(before))
    spans = span.groupBy("row", "base", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = spans.groupBy("row", "base").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    around = stretches.select("row", "doc_id", "base", "words").join(spans, ["row", "base"])
    last = F.col("base") + F.size("words") - SHINGLE
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["low"], F.least(s["high"], last))))
    word = lambda at, k: F.get("words", at - F.col("base") + k)
    place = lambda at: F.struct(at.alias("at"), F.xxhash64(*(word(at, k) for k in range(SHINGLE))).alias("hash"), F.concat_ws(" ", *(word(at, k) for k in range(SHINGLE))).alias("shingle"))
    texts = around.select("row", "doc_id", F.explode(F.transform(places, place)).alias("place")).select("row", "doc_id", "place.*")
    shared = texts.join(small(shingles), ["hash", "shingle"]).select("row", "t", "doc_id", "hash", "shingle", "at")
    shared = shared.join(retrieved.select("row", "t", "license", "reach", "own").distinct(), ["row", "t"])

    last_seen = F.lag("at").over(Window.partitionBy("row", "t", "hash", "shingle").orderBy("at"))
    since = F.greatest(F.coalesce(last_seen, F.lit(-1)), F.col("at") - F.col("reach")) + 1
    step = lambda at, change, start: F.struct(at.alias("at"), F.lit(change).alias("change"), F.lit(start).alias("start"))
    steps = shared.select("row", "t", "doc_id", "license", "own", "at", since.alias("since"))
    steps = steps.select("row", "t", "doc_id", "license", "own", F.explode(F.array(step(F.col("since"), 1, False), step(F.col("at"), 0, True), step(F.col("at") + 1, -1, False))).alias("step"))
    steps = steps.select("row", "t", "doc_id", "license", "own", "step.*")
    running = F.sum("change").over(Window.partitionBy("row", "t").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    good = steps.withColumn("share", running / F.col("own")).where(F.col("start") & (F.col("share") >= CONTAINED))
    best = F.max(F.struct("share", (-F.col("at")).alias("back")))
    found = good.groupBy("row", "doc_id", "license").agg(best.alias("best"), F.countDistinct("at").alias("n_places"))
    return found.select("doc_id", "license", F.col("best.share").alias("share"), (-F.col("best.back")).alias("first_word"), "n_places")


#: The brute-force definition in SQL: every stretch that starts at a shared shingle, without MinHash.
def oracle_sql(templates: dict[str, str] | None = None) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((templates or TEMPLATES).items()))
    tokens = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, {tokens.format("text")} AS w FROM (VALUES {rows}) AS v(license, text)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i+4], ' ') AS s FROM t, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
tn AS (SELECT license, max(len(w)) - 4 AS n FROM t GROUP BY license),
td AS (SELECT license, count(*) AS own FROM ts GROUP BY license),
d AS (SELECT row_number() OVER () AS r, doc_id, {tokens.format("coalesce(text, '')")} AS w FROM documents),
ds AS (SELECT r, doc_id, i - 1 AS p, array_to_string(w[i:i+4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
h AS (SELECT r, doc_id, license, p, s FROM ds JOIN ts USING (s)),
g AS (SELECT a.r, a.doc_id, a.license, a.p, count(DISTINCT b.s) AS shared
      FROM h a JOIN tn ON tn.license = a.license JOIN h b ON b.r = a.r AND b.license = a.license AND b.p >= a.p AND b.p < a.p + ceil(tn.n * {ROOM})
      GROUP BY ALL),
k AS (SELECT g.r, g.doc_id, g.license, g.p, g.shared / td.own AS share FROM g JOIN td USING (license) WHERE g.shared / td.own >= {CONTAINED})
SELECT doc_id, license, max(share) AS share FROM k GROUP BY r, doc_id, license
"""
