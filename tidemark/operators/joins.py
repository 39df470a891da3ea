"""Joins that Spark SQL has no words for: as-of and band joins, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import window_start
from tidemark.model import Rejected


def _own(n: int, *frames: DataFrame) -> list[str]:
    """Names that no column of the frames has, whatever their case."""
    taken = {c.lower() for f in frames for c in f.columns}
    free = (f"own_{i}" for i in range(n + len(taken)))
    return [c for c in free if c not in taken][:n]


def _apart(left: DataFrame, names: list[str]) -> None:
    both = {c.lower() for c in left.columns} & {c.lower() for c in names}
    if both:
        raise Rejected(f"columns of both sides have the same names: {sorted(both)}")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the values of ``take`` from the last right row of its key at or before its time; nulls without one.

    One shuffle by key: both sides are put in one order and the last right row is carried forward.  Right rows of
    equal key and time: the greatest values of ``take`` win.  Left rows with a null key or time find nothing; ``take`` may not name columns of the left side.
    """
    _apart(left, take)
    at, side, right_row, left_row, found = _own(5, left, right)
    mark = F.struct(F.lit(True).alias("is"), *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(take)])
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    keys = [F.col(f"`{c}`") for c in by]
    right = right.where(F.col(f"`{right_time}`").isNotNull())
    for c in keys:
        right = right.where(c.isNotNull())
    tagged_right = right.select(*keys, F.col(f"`{right_time}`").alias(at), mark.alias(right_row), F.lit(0).alias(side), F.lit(None).cast(left.select(whole).schema[0].dataType).alias(left_row))
    tagged_left = left.select(*keys, F.col(f"`{left_time}`").alias(at), F.lit(None).cast(tagged_right.schema[right_row].dataType).alias(right_row), F.lit(1).alias(side), whole.alias(left_row))
    order = Window.partitionBy(*keys).orderBy(at, side, right_row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = tagged_right.unionByName(tagged_left).withColumn(found, F.last(right_row, ignorenulls=True).over(order))
    return both.where(F.col(side) == 1).select(f"{left_row}.*", *[F.col(f"{found}.t{i}").alias(c) for i, c in enumerate(take)])


def band_join(left: DataFrame, right: DataFrame, by: list[str], left_time: Column, right_time: Column, before_us: int) -> DataFrame:
    """Inner join on ``by`` and right_time in [left_time - before_us, left_time], through equal buckets of that width.

    Each right row stands in its bucket and the next, so an equality join meets every pair and a filter keeps the exact ones.
    Null keys and times meet nothing; besides ``by`` the sides may not share names.
    """
    _apart(left.drop(*by), right.drop(*by).columns)
    width = max(before_us, 1)
    r_time, l_time, bucket = _own(3, left, right)
    spread = right.withColumn(r_time, right_time).withColumn(bucket, F.explode(F.array(window_start(F.col(r_time), width), window_start(F.col(r_time), width) + width)))
    keyed = left.withColumn(l_time, left_time).withColumn(bucket, window_start(F.col(l_time), width))
    met = keyed.join(spread, [*by, bucket]).where((F.col(r_time) <= F.col(l_time)) & (F.col(r_time) >= F.col(l_time) - before_us))
    return met.drop(bucket, l_time, r_time)
