"""What op12_pieces does once: neighbours checked by each piece's own merges, ids and texts that stay in their task."""

import random

import public_tokenizers

from lexiloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def merged_whole(model, first, text):
    """The symbols that merging the texts in a row leaves, leftmost best pair first; none where a merge crosses the border."""
    symbols, sizes = list(first + text), len(first)
    while True:
        costs = [model.rank.get(a + b, pieces.NEVER) for a, b in zip(symbols, symbols[1:])]
        if min(costs, default=pieces.NEVER) == pieces.NEVER:
            return symbols
        k = costs.index(min(costs))
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        at = sum(map(len, symbols[:k]))
        if at < sizes < at + len(symbols[k]):
            return []


def test_neighbours_by_their_own_merges_as_by_merging_both_texts():
    model, rng = pieces.PieceModel(MODEL), random.Random(7)
    ids = list(model.text)
    split = [(a, b) for i in rng.sample(ids, 1500) for k in range(1, len(model.text[i])) if (a := model.id.get(model.text[i][:k])) and (b := model.id.get(model.text[i][k:]))]
    unknown = -1 - ord("𓂀")
    some = [(a, b) for a in rng.sample(ids, 60) for b in rng.sample(ids, 50)] + split + [(unknown, ids[9]), (ids[9], unknown), (unknown, unknown)]
    answers = [model.compatible(a, b) for a, b in some]
    assert answers == [len(merged_whole(model, model._text(a), model._text(b))) == 2 for a, b in some]
    assert True in answers and False in answers
    assert all(model.compatible(pieces.START, i) == (len(merged_whole(model, "", model._text(i))) == 1) for i in rng.sample(ids, 500))


def test_round_trip_is_one_pass(spark):
    df = spark.createDataFrame([(1, "one text"), (2, None), (3, "")], "doc_id long, text string")
    trip = pieces.round_trip(df, MODEL)
    assert trip._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.n_tokens for r in trip.collect()} == {r.doc_id: len(r.ids) for r in pieces.encode(df, MODEL).collect()}
