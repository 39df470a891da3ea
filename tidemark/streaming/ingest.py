"""Structured Streaming into the database, and rollups of streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.engine import Database
from tidemark.model import MEASUREMENT
from tidemark.operators import rollup as ru


def json_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Measurements from new JSON files of a folder, a bounded number of files to a batch."""
    return spark.readStream.schema(MEASUREMENT).option("maxFilesPerTrigger", max_files).json(folder)


def into_table(stream: DataFrame, database: Database, table: str, checkpoint: str, *, name: str, clock_us: Callable[[], int] | None = None, once: bool = False) -> StreamingQuery:
    """Each micro-batch as one atomic commit.

    The request id is the stream's name and the batch's number, so a batch that is run again after a failure
    finds its receipt and adds nothing.  Late and out-of-order rows follow the table's policy; no watermark drops rows silently.
    """
    clock = clock_us or (lambda: time.time_ns() // 1000)

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            database.write(table, f"{name}:{number}", batch, clock())

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def rollup_deltas(stream: DataFrame, widths_us: list[int], sink: Callable[[DataFrame], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """A delta of states for each micro-batch of stored rows; deltas merge with ``operators.rollup.merge``."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: sink(ru.rollup(batch, widths_us))).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
