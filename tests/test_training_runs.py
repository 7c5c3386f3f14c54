"""Training that goes on after it was ended, and counters while it runs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom import cli
from lexiloom.operators import segment as S
from lexiloom.plans import train as training
from lexiloom.storage import is_there
from lexiloom.streaming import pipe


def corpus_and_words(spark, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("的一是不了人我在有他") for _ in range(rng.randrange(2, 5))) for _ in range(60)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + "，" for _ in range(300)]
    candidates = {t[i : i + k] for t in texts[:60] for k in (1, 2, 3) for i in range(len(t) - k)} | set(words) | set("的一是不了人我在有他")
    corpus = spark.createDataFrame([(t,) for t in texts], "text string")
    return corpus.cache(), spark.createDataFrame([(w,) for w in sorted(candidates) if "，" not in w], "word string").cache()


def rows(df):
    return sorted((r["word"], r["freq"]) for r in df.collect())


def test_a_run_that_was_ended_goes_on(spark, tmp_path):
    corpus, words = corpus_and_words(spark)
    counts = []
    wanted = rows(training.train(corpus, words, 30, 1, 2, on_counts=lambda *x: counts.append(x)))
    rounds = max(number for number, _ in counts)
    assert rounds >= 3
    folder = str(tmp_path / "journal")

    class Killed(Exception):
        pass

    def kill(number, _):
        if number == 3:
            raise Killed

    with pytest.raises(Killed):
        training.train(corpus, words, 30, 1, 2, journal=folder, on_round=kill)
    assert is_there(spark, f"{folder}/round-3-kept") and not is_there(spark, f"{folder}/round-4-kept")
    # what is left of a table that was being written is written again
    (tmp_path / "journal" / "round-3-kept" / "_SUCCESS").unlink()
    again = []
    assert rows(training.train(corpus, words, 30, 1, 2, journal=folder, on_counts=lambda *x: again.append(x))) == wanted
    # losses of the rounds before aren't computed again
    assert {n for n, c in again if "loss" in c} == set(range(4, rounds + 1))
    assert rows(training.train(corpus.limit(0), words, 30, 1, 2, journal=folder)) == wanted  # all is there
    with pytest.raises(ValueError):
        training.train(corpus, words, 31, 1, 2, journal=folder)


def test_counters_of_a_round(spark):
    corpus, words = corpus_and_words(spark, 2)
    told, kept = [], {}
    training.train(corpus, words, 30, 1, 2, max_rounds=1, on_counts=lambda *x: told.append(x), on_round=lambda n, df: kept.update({n: df.count()}))
    chunks = S.chunk_counts(corpus)
    start = training.em_step(chunks, S.match_counts(corpus, words))
    losses = S.word_loss(chunks, start).agg(F.count("*"), F.sum("cnt"), F.sum("loss")).first()
    assert [n for n, _ in told] == [1, 1]
    assert (told[0][1]["words"], told[0][1]["tokens"]) == (losses[0], losses[1]) and told[0][1]["loss"] == pytest.approx(losses[2])
    assert told[1][1] == {"kept": kept[1], "dropped": losses[0] - kept[1]}


def test_command_line_tells_counters(spark, tmp_path, capfd):
    corpus, words = corpus_and_words(spark, 3)
    (tmp_path / "c.txt").write_text("\n".join(r["text"] for r in corpus.collect()) + "\n")
    (tmp_path / "w.txt").write_text("\n".join(r["word"] for r in words.collect()) + "\n")
    arguments = ["train", "--dict", str(tmp_path / "w.txt"), str(tmp_path / "c.txt"), str(tmp_path / "out"), "--vocabulary", "60", "--sub-iterations", "1", "--min-count", "2", "--journal", str(tmp_path / "j")]
    cli.run(spark, arguments)
    said = capfd.readouterr().err
    assert "round 1: words" in said and "kept" in said
    cli.run(spark, ["prune", "--dict", str(tmp_path / "out"), str(tmp_path / "c.txt"), str(tmp_path / "losses")])
    assert "tokens" in capfd.readouterr().err


def test_streams_tell_their_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("他是英国人Tom\n\n")
    lexicon = spark.createDataFrame([("英国人", 30), ("他", 50), ("是", 40)], "word string, freq bigint")
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    said = []
    progress = pipe.Progress(said.append)
    spark.streams.addListener(progress)
    try:
        cut = pipe.counted_stream(pipe.cut_stream(lines, lexicon))
        cut.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if progress.batches == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert (progress.batches, progress.lines, progress.words) == (3, 6, 12) and said[-1] == "6 lines, 12 words"
