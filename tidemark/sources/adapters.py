"""The shared tables as measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.expr(f"unix_micros(convert_timezone('UTC', current_timezone(), cast({column} as timestamp_ntz))::timestamp)")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored rows: type, user and properties as tenant, series and tags, a hundred rows to a commit."""
    return table(spark, sf_dir, "events").select(
        micros("ts").alias("timestamp_us"),
        F.col("event_type").alias("tenant"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("series"),
        "value",
        F.col("props").alias("tags"),
        F.expr("event_id div 100 + 1").alias("sequence"),
        (F.col("event_id") % 100).alias("ordinal"),
    )


def ship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as measurements of quantity by ship date, with many equal times."""
    return table(spark, sf_dir, "lineitem").select(
        micros("l_shipdate").alias("timestamp_us"),
        F.concat("l_returnflag", "l_linestatus").alias("tenant"),
        F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("series"),
        F.col("l_quantity").alias("value"),
        F.lit("{}").alias("tags"),
        (F.col("l_orderkey") + 1).alias("sequence"),
        F.col("l_linenumber").cast("bigint").alias("ordinal"),
    )
