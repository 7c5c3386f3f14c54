"""Where intermediate tables are kept so that lost executors cost a re-read, not a re-run."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; where it names none a temporary one is set, if the session is local.

    On a cluster executors don't see the driver's folders, so there a missing setting raises.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to path, in whatever store Spark reads."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def whole_versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers n of the tables folder/version=n that are written as a whole."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    names = (status.getPath().getParent().getName().removeprefix("version=") for status in found)
    return sorted(int(name) for name in names if name.isdigit())
