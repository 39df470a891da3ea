"""Cutting a frame from its lineage, in the folder that all executors share.

Frames of any size, empty ones too, come back with the same rows; what they held is never changed.  Spark deletes a
checkpoint once nothing refers to it, if spark.cleaner.referenceTracking.cleanCheckpoints is set; files of ``stored`` go with the folder.

Shuffle files that made a frame go as soon as it is written: else they stay until the driver happens to collect its garbage, and
the disk holds those of all rounds of a loop.

Frames of a few numbers a row are written by as many tasks as their rows need (``gathered``), not as many as shuffles or the input have partitions. Each file
costs more than its rows there: on a local file system without native libraries, Spark's writers start a process for it (chmod), which shares the executor's memory until it runs.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows of a few numbers to a task that writes them.
TASK_ROWS = 100_000
#: Bytes of input to a task that reads it, at least.
TASK_BYTES = 8 << 20

#: Spark's setting for it, of 4.1; older versions don't know it and keep the files until then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Frames that are made and run within leave no shuffle files; the session's setting comes back after."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """The frame's rows, written to the checkpoint folder: lost executors don't lose them, and readers don't compute them again.

    The folder is ``spark.checkpoint.dir``.
    """
    shared_folder(df.sparkSession)
    with without_leftovers(df.sparkSession):
        return df.select("*").checkpoint()


def tasks_for(df: DataFrame, rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for so many rows at most: the cores' number at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))


def gathered(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """The frame in no more tasks than so many rows need; nothing is shuffled."""
    return df.coalesce(tasks_for(df, rows, each))


def gathered_input(df: DataFrame) -> DataFrame:
    """A frame that reads files, in no more tasks than its bytes need.  The bytes are Spark's estimate for its plan, which takes no job; where it knows none, nothing changes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = tasks_for(df, size, TASK_BYTES)
    return df.coalesce(tasks) if tasks < 1 << 31 else df


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: for whole texts, which columns compress."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with without_leftovers(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine only where executors run in this process, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()
