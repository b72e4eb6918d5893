"""Reading the driver's tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the star-schema tables, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else ValueError.

    On a cluster a temporary folder would be another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-strandloom-"))
            option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get()
    return found.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def _tables(spark: SparkSession) -> set[str]:
    """Paths of the tables that this application has written and not deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {f.getPath().toString() for f in files.listStatus(path)} if files.exists(path) else set()


@contextmanager
def step_scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a ``materialise`` whose tables stay; all other tables written within the block are deleted at its end.

    For steps whose results are written before the next one begins. Nothing else may run in the application meanwhile, and
    DataFrames that were made within the block, but for what was kept, can't be read after it. On an error nothing is deleted.
    """
    before, kept = _tables(spark), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        here = _tables(spark)
        out = materialise(df, name)
        kept.update(p for p in _tables(spark) - here if p.rsplit("/", 1)[-1].startswith(f"{name}-"))
        return out

    yield keep
    for path in _tables(spark) - before - kept:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; call it when no DataFrame that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's path among the tables of this application."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that a lost executor repeats no earlier work."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
