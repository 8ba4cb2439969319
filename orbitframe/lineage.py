"""Cutting the plan of an operator that works in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below spark.checkpoint.dir, which all executors share.

    Without that setting a folder of our own is taken where driver and executors are one process, and is an error elsewhere.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or tempfile.mkdtemp(prefix='shared-')).rstrip('/')}/{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all cores, for work that costs much more a row than a byte.

    A small file is read by one task, however many rows it has, and shuffles by a key may be drawn together again by size.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def written(df: DataFrame) -> DataFrame:
    """The frame written once to a new shared folder and read back by columns, for rounds whose results several parts read."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """The frame written to spark.checkpoint.dir, the folder that all executors share, and read back.

    Without that setting a folder of our own is taken where driver and executors are one process, and is an error elsewhere.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)
