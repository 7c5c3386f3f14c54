"""Times the headline queries; prints one JSON line.

Each query runs RUNS times while BUDGET seconds last, and its median counts. The
value is the sum over HEADLINE; MORE are timed once, and training too with
BENCH_FULL=1. cold_start is the time from the first import to the first result.
"""

from __future__ import annotations

import time

BEGAN = time.perf_counter()

import json  # noqa: E402
import os  # noqa: E402
import tempfile  # noqa: E402
from statistics import median  # noqa: E402

from pyspark.sql import SparkSession  # noqa: E402

from lexiloom.plans import catalog  # noqa: E402

HEADLINE = ("pretokenize_counts", "sentence_split", "seed_lexicon", "viterbi_cut", "cut_token_counts", "word_loss")
MORE = ("cut_documents", "viterbi_cut_native", "em_one_iteration")
RUNS, BUDGET = 3, 150


def children_peak_mb() -> float:
    """The largest resident memory that any process of this one's children has had so far."""
    most = 0.0
    for pid in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{pid}/status") as f:
                status = dict(line.split(":", 1) for line in f if ":" in line)
            if os.getsid(int(pid)) == os.getsid(0):
                most = max(most, int(status["VmHWM"].split()[0]) / 1024)
        except (OSError, KeyError):
            continue
    return most


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = catalog.queries()

    def timed(name: str) -> float:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timed(HEADLINE[0])  # starts the workers
    cold = time.perf_counter() - BEGAN
    runs: dict[str, list[float]] = {name: [timed(name)] for name in HEADLINE}
    for _ in range(RUNS - 1):
        for name in HEADLINE:
            if time.perf_counter() - BEGAN < BUDGET:
                runs[name].append(timed(name))
    more = {name: round(timed(name), 3) for name in (*MORE, *(["em_train"] if os.environ.get("BENCH_FULL") else ()))}
    seconds = {name: round(median(own), 3) for name, own in runs.items()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total of the headline queries, medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rpartition("sf")[2],
                "runs": {name: len(own) for name, own in runs.items()},
                "more": more,
                "cold_start": round(cold, 3),
                "documents_per_second": {name: round(documents / s) for name, s in (seconds | more).items()},
                "peak_mb_of_a_process": round(children_peak_mb()),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
