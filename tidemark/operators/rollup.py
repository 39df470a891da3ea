"""Rollups of several widths: count, sum, least, greatest, first and last value of each bucket.

A rollup's state can be merged, so batches are aggregated on their own (with partial
aggregation before the shuffle) and states are merged by key; late rows land in old
buckets.  Several widths share one scan: rows are exploded by width before the one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import is_finite, window_start
from tidemark.model import ROLLUP_KEY

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def rollup(rows: DataFrame, widths_us: Iterable[int], after_us: int | None = None, by: Iterable[str] = ()) -> DataFrame:
    """States of stored rows; buckets that end at after_us or before are left out.  by: columns whose values are kept apart, as batches are."""
    wide = rows.withColumn("width_us", F.explode(F.array(*[F.lit(w).cast("bigint") for w in widths_us])))
    wide = wide.withColumn("bucket_us", window_start(F.col("timestamp_us"), F.col("width_us")))
    if after_us is not None:
        wide = wide.where(F.col("bucket_us") + F.col("width_us") > after_us)
    return (
        wide.groupBy(*by, *ROLLUP_KEY)
        .agg(
            F.count("*").alias("count"),
            F.sum("value").alias("sum"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.min(F.struct("timestamp_us", "sequence", "ordinal", "value")).alias("lo"),
            F.max(F.struct("timestamp_us", "sequence", "ordinal", "value")).alias("hi"),
        )
        .select(
            *by, *ROLLUP_KEY, "count", "sum", "min", "max",
            F.col("lo.value").alias("first"), F.col("hi.value").alias("last"),
            F.col("lo.timestamp_us").alias("first_timestamp_us"), F.col("hi.timestamp_us").alias("last_timestamp_us"),
            F.col("lo.sequence").alias("first_sequence"), F.col("lo.ordinal").alias("first_ordinal"),
            F.col("hi.sequence").alias("last_sequence"), F.col("hi.ordinal").alias("last_ordinal"),
        )
    )


def merge(states: DataFrame) -> DataFrame:
    """One state for each key of states that may repeat keys."""
    return (
        states.groupBy(*ROLLUP_KEY)
        .agg(
            F.sum("count").alias("count"),
            F.sum("sum").alias("sum"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.min(F.struct("first_timestamp_us", "first_sequence", "first_ordinal", "first")).alias("lo"),
            F.max(F.struct("last_timestamp_us", "last_sequence", "last_ordinal", "last")).alias("hi"),
        )
        .select(
            *ROLLUP_KEY, "count", "sum", "min", "max", "lo.first", "hi.last", "lo.first_timestamp_us", "hi.last_timestamp_us",
            "lo.first_sequence", "lo.first_ordinal", "hi.last_sequence", "hi.last_ordinal",
        )
    )


def view(states: DataFrame) -> DataFrame:
    """The relation that SQL sees: states with average, open, high, low and close."""
    return states.withColumns(
        {
            "average": F.col("sum") / F.nullif(F.col("count"), F.lit(0)),
            "open": F.col("first"),
            "high": F.col("max"),
            "low": F.col("min"),
            "close": F.col("last"),
        }
    )


def named(view_rows: DataFrame, width_us: int) -> DataFrame:
    """One continuous aggregate: the view's rows of a width."""
    return view_rows.where(F.col("width_us") == width_us).withColumn("count", F.col("count").cast("bigint"))


def coarsen(states: DataFrame, width_us: int) -> DataFrame:
    """States of a width that the given states' widths divide, without reading rows again."""
    wider = states.withColumn("bucket_us", window_start(F.col("bucket_us"), width_us)).withColumn("width_us", F.lit(width_us).cast("bigint"))
    return merge(wider)


def not_finite(states: DataFrame) -> DataFrame:
    return states.where(~is_finite(F.col("sum")))


def is_sound() -> Column:
    """What every state obeys."""
    return (
        (F.col("count") > 0)
        & F.col("first").between(F.col("min"), F.col("max"))
        & F.col("last").between(F.col("min"), F.col("max"))
        & (F.col("first_timestamp_us") <= F.col("last_timestamp_us"))
        & ((F.col("count") > 1) | (F.col("first") == F.col("last")))
        & (F.pmod("bucket_us", "width_us") == 0)
        & F.col("first_timestamp_us").between(F.col("bucket_us"), F.col("bucket_us") + F.col("width_us") - 1)
        & F.col("last_timestamp_us").between(F.col("bucket_us"), F.col("bucket_us") + F.col("width_us") - 1)
    )


def broken(states: DataFrame) -> DataFrame:
    """States that break what every state obeys; empty for sound ones."""
    return states.where(~is_sound())
