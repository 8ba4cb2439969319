"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to spark.checkpoint.dir and read back; without one, a folder of our own where driver and executors are one process."""
    _ensure_folder(df)
    return df.checkpoint(eager=True)


def _ensure_folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the folder of the checkpoints, read back; it is compressed and its columns are read one by one."""
    context = df.sparkSession.sparkContext
    _ensure_folder(df)
    path = f"{context._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def released() -> None:
    """Gives a worker's freed memory back to the system, which Arrow's pool and the C library otherwise keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)
