"""Command line: python -m lexiloom.cli MODE ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import Cutter
from .operators import lexicon as L
from .operators import segment as S
from .operators.ordered import good_titles_in_order
from .plans.build import build_lexicon
from .plans.train import LEAST, SUB_ITERATIONS, VOCABULARY, train
from .sources import dumps, files
from .sources.splits import PIECE
from .streaming.lexicons import cut_batches, publish
from .streaming.pipe import cut_to_lines


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="lexiloom", description="Segment text, count words and learn lexicons on Spark.")
    modes = main.add_subparsers(dest="mode", required=True)

    def mode(name, *paths, lexicon="required"):
        sub = modes.add_parser(name)
        if lexicon:
            sub.add_argument("--dict", required=lexicon == "required")
        for p in paths:
            sub.add_argument(p)
        return sub

    mode("segment", "input", "output")
    mode("cut", "input", "output")
    mode("count", "input", "output", lexicon="optional")
    mode("prune", "input", "output")
    mode("chars", "input", "output", lexicon="")
    mode("sentences", "input", "output", lexicon="")
    sub = mode("filter-lexicon", "char_counts", "words", "output", lexicon="")
    sub.add_argument("--min-count", type=int, default=2)
    convert = {"action": "append", "default": [], "help": "a conversion table, source TAB target; of several each works on what the one before made"}
    mode("titles", "input", "output", lexicon="").add_argument("--convert", **convert)
    mode("redirects", "pages", "redirects", "output", lexicon="").add_argument("--convert", **convert)
    mode("wikitext", "input", "output", lexicon="")
    mode("clean", "input", "output", lexicon="").add_argument("--convert", **convert)
    sub = mode("lexicon", "output", lexicon="")
    for source in ("titles", "wiktionary", "wikisource", "slang", "redirects"):
        sub.add_argument(f"--{source}")
    sub = mode("train", "input", "output")
    sub.add_argument("--vocabulary", type=int, default=VOCABULARY)
    sub.add_argument("--sub-iterations", type=int, default=SUB_ITERATIONS)
    sub.add_argument("--min-count", type=int, default=LEAST)
    sub.add_argument("--journal", help="a folder that keeps every table of the run; a run that was ended goes on there")
    sub = mode("build", "articles", "words", "folder", "output", lexicon="")
    sub.add_argument("--vocabulary", type=int, default=VOCABULARY)
    sub.add_argument("--sub-iterations", type=int, default=SUB_ITERATIONS)
    sub.add_argument("--min-count", type=int, default=LEAST)
    sub = mode("stream", "input", "output", lexicon="")
    given = sub.add_mutually_exclusive_group(required=True)
    given.add_argument("--dict")
    given.add_argument("--versions", help="a folder of published lexicons; each batch takes the newest one")
    sub.add_argument("--checkpoint", required=True)
    mode("publish", "versions")
    mode("repl")
    return main


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    tables = [files.read_conversion(spark, path) for path in getattr(a, "convert", ())]
    if a.mode == "repl":
        cutter = Cutter(spark, a.dict)
        for line in sys.stdin:
            text = line.rstrip("\n")
            if text in ("", "q", "quit"):
                return
            print("/".join(cutter.cut(text)))
        return
    if a.mode == "stream":
        lines = spark.readStream.text(a.input)
        lexicon = a.versions or files.read_lexicon(spark, a.dict)
        if a.versions or lexicon.limit(S.BROADCAST_WORDS + 1).count() > S.BROADCAST_WORDS:
            stream = cut_batches(lines, lexicon, a.output, a.checkpoint, form="text").trigger(availableNow=True).start()
        else:
            stream = cut_to_lines(lines, lexicon).writeStream.option("checkpointLocation", a.checkpoint).trigger(availableNow=True).start(a.output, format="text")
        stream.awaitTermination()
        return
    if a.mode == "publish":
        print(f"version {publish(files.read_lexicon(spark, a.dict), a.versions)}", file=sys.stderr)
        return
    if a.mode == "build":
        files.write_counts(build_lexicon(spark, files.read_articles(spark, a.articles), files.read_words(spark, a.words), a.folder, a.vocabulary, a.sub_iterations, a.min_count), a.output)
        return
    if a.mode == "filter-lexicon":
        counts = files.lexicon_rows(spark.read.text(a.char_counts)).select(F.col("word").alias("ch"), F.col("freq").alias("cnt"))
        words = files.read_words(spark, a.words).withColumn("line", F.monotonically_increasing_id())
        kept, seen = files.counted(L.filtered_in_order(words, counts, a.min_count), "kept")
        kept.write.text(a.output)
        print(f"{seen.get['rows']} words kept", file=sys.stderr)
        return
    if a.mode == "redirects":
        pages, links = (dumps.insert_tuples(files.read_corpus(spark, path), "text", PIECE) for path in (a.pages, a.redirects))
        dumps.redirect_pairs(dumps.pages(pages), dumps.redirects(links), tables=tables).write.csv(a.output, sep="\t", quote="")
        return
    if a.mode == "lexicon":
        lines = {k: files.read_corpus(spark, path).select(F.col("text").alias("word")) if (path := getattr(a, k)) else None for k in ("titles", "wiktionary", "wikisource", "slang", "redirects")}
        sides = lines["redirects"] and lines["redirects"].select(F.get(F.split("word", "\t"), F.lit(0)).alias("source"), F.get(F.split("word", "\t"), F.lit(1)).alias("target"))
        kept = [lines["titles"] and L.title_words(lines["titles"]), sides and L.redirect_words(sides)]
        kept += [lines[k] and L.pure_words(lines[k], longest) for k, longest in (("wiktionary", 4), ("wikisource", 3), ("slang", 3))]
        L.with_constituents(L.union_words(*kept)).orderBy("word").write.text(a.output)
        return
    if a.mode == "wikitext":
        dumps.list_words(spark.read.text(a.input, wholetext=True).withColumnRenamed("value", "source")).write.text(a.output)
        return
    if a.mode == "clean":
        files.process_articles(files.read_articles(spark, a.input), tables=tables).select("text").write.text(a.output)
        return
    corpus = files.read_corpus(spark, a.input)
    if a.mode == "titles":
        numbered = corpus.select(F.monotonically_increasing_id().alias("line"), F.col("text").alias("title"))
        good_titles_in_order(numbered, tables=tables).orderBy("line").select("title").write.text(a.output)
        return
    if a.mode == "chars":
        L.char_counts(corpus).orderBy(F.desc("cnt"), "ch").write.csv(a.output, sep="\t", quote="")
    elif a.mode == "sentences":
        files.split_sentences(corpus).select(F.col("sentence").alias("value")).write.text(a.output)
    elif a.mode == "count":
        files.write_counts(S.recount(corpus, files.read_words(spark, a.dict) if a.dict else None, "text"), a.output)
    elif a.mode == "prune":
        losses, seen = files.counted(S.word_loss(S.chunk_counts(corpus), files.read_lexicon(spark, a.dict)), "losses", F.sum("cnt").alias("tokens"), F.sum("loss").alias("loss"))
        files.write_losses(losses, a.output)
        print(", ".join(f"{v} {k}" for k, v in seen.get.items()), file=sys.stderr)
    elif a.mode == "train":
        told = lambda number, counts: print(f"round {number}: " + ", ".join(f"{k} {v}" for k, v in counts.items()), file=sys.stderr, flush=True)
        files.write_counts(train(corpus, files.read_words(spark, a.dict), a.vocabulary, a.sub_iterations, a.min_count, journal=a.journal, on_counts=told), a.output)
    else:
        rows = corpus.withColumn("doc_id", F.monotonically_increasing_id())
        # both keep the order of the lines where the lexicon is broadcast
        tokens = S.cut(rows, files.read_lexicon(spark, a.dict)) if a.mode == "cut" else S.segment_longest_match(rows, files.read_words(spark, a.dict))
        files.write_tokens(tokens, a.output)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
