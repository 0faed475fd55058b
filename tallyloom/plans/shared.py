"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder of its own, and the setting is made; on a
    cluster that is an error, as a machine's own folder is of no use to the other executors.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: cuts the lineage and survives the loss of executors.

    The files stay as long as results may read them: until ``clear``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_written = True
    return out


def once(df: DataFrame, name: str) -> DataFrame:
    """The frame written, unless it is as it was read back."""
    return df if getattr(df, "is_written", None) is True else written(df, name)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; frames that read it can't be used any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores, for work in Python that costs far more than a row's move.

    A table in a few small files would otherwise be one task's work; a large table has more partitions than that and
    is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
