"""Where intermediate tables are kept, and how they are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import materialise, shared_folder

__all__ = ["free_name", "materialise", "materialise_by", "materialise_once", "shared_folder", "shuffle_partitions", "table"]


def materialise_once(df: DataFrame) -> DataFrame:
    """df in the checkpoint folder; the shuffle files of its making go at once, where else they stay until the driver collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        # a new frame takes the setting
        return materialise(df.select("*"))
    finally:
        conf.set(name, before)


def materialise_by(df: DataFrame, key: str) -> DataFrame:
    """df in the checkpoint folder, dealt by key so that later joins and groups on key needn't move it.

    A plan that is replanned while it runs doesn't tell its partitioning to what
    reads its checkpoint, so adaptive execution rests for this one write.
    """
    conf = df.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return materialise_once(df.repartition(shuffle_partitions(df), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
