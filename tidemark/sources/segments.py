"""Raw rows as Parquet segments: dealt by shard and event window, sorted within files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import shard_for, window_start
from tidemark.model import STORED

#: Bytes of a row group before compression, some hundred thousand rows: a file of one task fills many in the next pass.
BLOCK = 8 << 20
SORT = ("tenant", "series", "timestamp_us", "sequence", "ordinal")


def placed(rows: DataFrame, shards: int, window_us: int) -> DataFrame:
    """Rows with their shard and event window."""
    return rows.withColumn("shard", shard_for(F.col("tenant"), F.col("series"), shards).cast("int")).withColumn("window", window_start(F.col("timestamp_us"), window_us))


def count_groups(rows: DataFrame, shards: int, window_us: int, more_than: int) -> dict[tuple[int, int], int]:
    """Rows of each (shard, window) that holds more than that."""
    found = placed(rows, shards, window_us).groupBy("shard", "window").agg(F.count("*").alias("rows")).where(F.col("rows") > more_than)
    return {(r["shard"], r["window"]): r["rows"] for r in found.collect()}


def write_segments(rows: DataFrame, path: str, shards: int, window_us: int, segment_rows: int, large: dict[tuple[int, int], int]) -> None:
    """One shuffle by (shard, window).  A group of segment_rows rows or less is one file, however partitions are split and joined; the others, whose rows are
    given (or more than those), are dealt into pieces, so a hot hour fills many tasks; files have segment_rows rows at most."""
    dealt = placed(rows.select(*STORED.names), shards, window_us)
    pieces = [(shard, window, -(-n // segment_rows)) for (shard, window), n in large.items() if n > segment_rows]
    if pieces:
        known = rows.sparkSession.createDataFrame(pieces, "shard int, window long, pieces long")
        dealt = dealt.join(F.broadcast(known), ["shard", "window"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64(*SORT), "pieces"), F.lit(0))).drop("pieces")
    else:
        dealt = dealt.withColumn("piece", F.lit(0).cast("bigint"))
    dealt = dealt.repartition("shard", "window", "piece").drop("piece").sortWithinPartitions("shard", "window", *SORT)
    dealt.write.partitionBy("shard", "window").option("maxRecordsPerFile", segment_rows).option("compression", "zstd").option("parquet.block.size", BLOCK).mode("overwrite").parquet(path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored rows of the given files, with the one schema that they must have."""
    if not paths:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(*paths)


def describe(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """A row for each file: name, shard, window, rows, least and greatest time."""
    rows = spark.read.schema(STORED).parquet(*[f"{root}/{n}" for n in names]).withColumn("file", F.input_file_name())
    found = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("timestamp_us").alias("min_us"), F.max("timestamp_us").alias("max_us"))
    part = lambda key: F.regexp_extract("file", f"/{key}=(-?[0-9]+)/", 1).cast("bigint")
    return found.select("file", part("shard").alias("shard"), part("window").alias("window"), "rows", "min_us", "max_us")


def faults(spark: SparkSession, expected: dict[str, dict]) -> list[str]:
    """Of files (path -> file, rows, min_us, max_us) those whose schema isn't the one, that hold nulls, or that hold other rows or times."""
    found = spark.read.option("mergeSchema", "true").parquet(*expected)
    own = [(f.name, f.dataType) for f in found.schema.fields if f.name not in ("shard", "window")]
    if own != [(f.name, f.dataType) for f in STORED.fields]:
        return [f"the files' columns are {', '.join(f'{n} {t.simpleString()}' for n, t in own)}"]
    nulls = F.count(F.when(F.greatest(*[F.col(c).isNull() for c in STORED.names]), 1))
    sums = found.groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"), F.min("timestamp_us").alias("min_us"), F.max("timestamp_us").alias("max_us"), nulls.alias("nulls"))
    seen = {r["path"].rsplit("segments/", 1)[-1]: r for r in sums.collect()}
    out = []
    for s in expected.values():
        r = seen.get(s["file"].split("segments/", 1)[-1])
        if r is None or (r["rows"], r["min_us"], r["max_us"]) != (s["rows"], s["min_us"], s["max_us"]):
            out.append(f"{s['file']}: other rows or times than the manifest says")
        elif r["nulls"]:
            out.append(f"{s['file']}: nulls")
    return out
