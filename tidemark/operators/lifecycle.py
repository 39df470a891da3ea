"""Admission rules as plans over frames: what the database decides for a batch, for any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import row_problem


def admit(requests: DataFrame) -> DataFrame:
    """request, copy, digest with outcome: the first of a request is accepted, equal repeats are duplicates, others conflict."""
    by = Window.partitionBy("request").orderBy("copy")
    first = F.first("digest").over(by.rowsBetween(Window.unboundedPreceding, 0))
    repeat = F.when(F.col("digest") == first, "duplicate").otherwise("conflict")
    return requests.withColumn("outcome", F.when(F.row_number().over(by) == 1, "accepted").otherwise(repeat))


def timed_ids(ids: DataFrame, floor_us: Column, latest_us: Column) -> DataFrame:
    """request_id of the form v1:<issued_us>:<nonce> with outcome: malformed, expired, future or valid."""
    issued = F.regexp_extract("request_id", r"^v1:(-?[0-9]+):.+$", 1).try_cast("bigint")
    outcome = F.when(issued.isNull(), "malformed").when(issued < floor_us, "expired").when(issued > latest_us, "future").otherwise("valid")
    return ids.withColumn("outcome", outcome)


def row_checks(rows: DataFrame) -> DataFrame:
    """Measurements with what is wrong with them, or none."""
    return rows.withColumn("problem", F.coalesce(row_problem(), F.lit("none")))
