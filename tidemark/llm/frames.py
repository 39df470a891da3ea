"""Small shared pieces: table access, Arrow batches and text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: texts are long, and each batch is in memory several times over.
BATCH_ROWS = 1000


#: Bytes of an Arrow batch, about: a batch ends with the row that passes them.
BATCH_BYTES = 8 << 20
#: Rows of a side that may be broadcast: some 50 MB with four numbers each.
BROADCAST_ROWS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(name)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def small_side(side: DataFrame) -> DataFrame:
    """A side of a join, of a few numbers a row, that was cut from its lineage: broadcast if its rows, counted here, are few enough, else shuffled."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("shuffle_merge")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, a null text as the empty one; other columns, whatever their names, stay out."""
    small_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows, without copies."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, at.astype(np.int64)


def released() -> None:
    """Gives free memory back to the machine: a worker lives on after its task, and what it holds adds up over stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What workers keep between tasks, by name: how to let go of it.
KEPT: dict[str, Callable[[], object]] = {}


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: str = "") -> DataFrame:
    """run over the Arrow batches of each partition, small ones; a task that ends gives its memory back.

    keeps: what of KEPT the tasks use; a worker lets go of the rest when such a task begins.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, let_go in KEPT.items():
            if name != keeps:
                let_go()
        try:
            yield from run(batches)
        finally:
            released()

    small_batches(df.sparkSession)
    return df.mapInArrow(whole, schema)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """f for each Arrow batch; the rows of a batch are independent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(batch)
            if out is not None and out.num_rows:
                yield out

    return mapped(df, run, schema)


def batch_of(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def groups_of(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of about limit bytes each, one row at least."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and total + n > limit:
            out.append((first, i))
            first, total = i, 0
        total += n
    return [*out, (first, len(sizes))] if len(sizes) > first else out


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names that no column of df has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = (f"own_{i}" for i in range(n + len(taken)))
    return [x for x in found if x not in taken][:n]
