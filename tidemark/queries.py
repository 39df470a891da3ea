"""Registered queries over the shared tables, each with the DuckDB SQL that must give the same rows.

Sums of decimal-valued doubles go through DECIMAL on both sides, so that the order of addition can't show; averages are
rounded; integers are cast, since the engines' result types differ.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine import Database
from tidemark.functions.exprs import shard_for, window_start
from tidemark.model import DAY_US, HOUR_US, MINUTE_US, Rejected
from tidemark.operators import rollup as ru
from tidemark.operators.joins import asof_join, band_join
from tidemark.operators.lifecycle import admit, row_checks, timed_ids
from tidemark.sources.adapters import event_rows, ship_rows, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EV = "(SELECT epoch_us(ts) AS timestamp_us, event_type AS tenant, 'user_' || user_id AS series, value, props AS tags, event_id // 100 + 1 AS sequence, event_id % 100 AS ordinal FROM events)"
SH = (
    "(SELECT epoch_us(l_shipdate) AS timestamp_us, l_returnflag || l_linestatus AS tenant, 'supp_' || l_suppkey AS series, l_quantity AS value, '{}' AS tags, "
    "l_orderkey + 1 AS sequence, CAST(l_linenumber AS BIGINT) AS ordinal FROM lineitem)"
)
CENTS = "decimal(18,2)"
#: A third and two thirds of the events' month.
THIRD, TWO_THIRDS = 1704931200000000, 1705795200000000


SHARDS = 4
#: Rows as one load stores them: tags canonical, the sequence after the table's own.
LOADED = f"(SELECT * EXCLUDE (sequence, tags), '{{\"k\":\"' || json_extract_string(tags, '$.k') || '\"}}' AS tags, CAST(2 AS BIGINT) AS sequence FROM {EV})"


def floor_to(x: str, width: int | str) -> str:
    """A bucket's start in DuckDB, floored below zero too."""
    return f"({x} - ((({x}) % {width}) + {width}) % {width})"


def register(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def cents(column: str) -> Column:
    return F.sum(F.col(column).cast(CENTS)).cast("double")


def in_cents(rows: DataFrame) -> DataFrame:
    """Values as decimals, whose sums are exact."""
    return rows.withColumn("value", F.col("value").cast(CENTS))


def as_double(states: DataFrame) -> DataFrame:
    """States of decimal values as the usual doubles."""
    return states.withColumns({c: F.col(c).cast("double") for c in ("sum", "min", "max", "first", "last")})


def rollup_sql(rows: str, width: int | str, extra: str = "") -> str:
    w = str(width)
    key = floor_to("timestamp_us", w)
    order = "(timestamp_us, sequence, ordinal)"
    return (
        f"SELECT CAST({w} AS BIGINT) AS width_us, {key} AS bucket_us, tenant, series, tags, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, min(value) AS min, max(value) AS max, "
        f"arg_min(value, {order}) AS first, arg_max(value, {order}) AS last, min(timestamp_us) AS first_timestamp_us, max(timestamp_us) AS last_timestamp_us, "
        f"CAST(arg_min(sequence, {order}) AS BIGINT) AS first_sequence, CAST(arg_min(ordinal, {order}) AS BIGINT) AS first_ordinal, "
        f"CAST(arg_max(sequence, {order}) AS BIGINT) AS last_sequence, CAST(arg_max(ordinal, {order}) AS BIGINT) AS last_ordinal FROM {rows} {extra} GROUP BY ALL"
    )


OHLC = "bucket_us, tenant, series, count, sum, round(sum / count, 6) AS average, first AS open, max AS high, min AS low, last AS close"

#: For sums of doubles, which come in any order.
OHLC2 = OHLC.replace("round(sum / count, 6)", "round(sum / count, 4)")


def ohlc(states: DataFrame) -> DataFrame:
    v = ru.view(states)
    return v.select("bucket_us", "tenant", "series", "count", "sum", F.round("average", 6).alias("average"), "open", "high", "low", "close")


# -- the five shapes of the benchmark -----------------------------------------------------------------------------


@register(f"SELECT timestamp_us, value FROM {EV} WHERE tenant = 'click' AND series = 'user_7' AND timestamp_us >= {TWO_THIRDS}")
def recent_series_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the database: the files of one shard and the last windows."""
    return loaded(spark, sf_dir).scan("events", start_us=TWO_THIRDS, tenant="click", series="user_7", ordered=False).select("timestamp_us", "value")


@register(f"SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM {EV}")
def full_count_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).agg(F.count("*").alias("n"), cents("value").alias("total"))


@register(f"SELECT tenant, series, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS high FROM {EV} GROUP BY tenant, series")
def cross_series_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).groupBy("tenant", "series").agg(F.count("*").alias("n"), cents("value").alias("total"), F.max("value").alias("high"))


@register(f"SELECT {OHLC2} FROM ({rollup_sql(EV, MINUTE_US)})")
def minute_continuous_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the states that the database keeps."""
    v = loaded(spark, sf_dir).rollups("events", width_us=MINUTE_US)
    return v.select("bucket_us", "tenant", "series", "count", F.round("sum", 2).alias("sum"), F.round("average", 4).alias("average"), "open", "high", "low", "close")


@register(f"SELECT tenant, series, timestamp_us, value, rn FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY value DESC, timestamp_us, sequence, ordinal) AS rn FROM {EV}) WHERE rn <= 5")
def window_top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tenant").orderBy(F.desc("value"), "timestamp_us", "sequence", "ordinal")
    ranked = event_rows(spark, sf_dir).withColumn("rn", F.row_number().over(w).cast("bigint"))
    return ranked.where("rn <= 5").select("tenant", "series", "timestamp_us", "value", "rn")


# -- rollups --------------------------------------------------------------------------------------------------------


@register(rollup_sql(EV, MINUTE_US))
def rollup_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(ru.rollup(in_cents(event_rows(spark, sf_dir)), [MINUTE_US]))


@register(rollup_sql(EV, HOUR_US))
def rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(ru.rollup(in_cents(event_rows(spark, sf_dir)), [HOUR_US]))


@register(" UNION ALL ".join(f"({rollup_sql(EV, w)})" for w in (HOUR_US, DAY_US, 7 * DAY_US)))
def rollup_multi_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(ru.rollup(in_cents(event_rows(spark, sf_dir)), [HOUR_US, DAY_US, 7 * DAY_US]))


#: Times of whole hours, so that many rows of a bucket are first and last at once: sequence and ordinal decide.
TIED = f"(SELECT {floor_to('timestamp_us', HOUR_US)} AS timestamp_us, tenant, 'all' AS series, value, '{{}}' AS tags, sequence, ordinal FROM {EV})"


def tied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    return rows.withColumns({"timestamp_us": window_start(F.col("timestamp_us"), HOUR_US), "series": F.lit("all"), "tags": F.lit("{}")})


@register(rollup_sql(TIED, HOUR_US))
def rollup_many_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(ru.rollup(in_cents(tied_rows(spark, sf_dir)), [HOUR_US]))


@register(rollup_sql(TIED, DAY_US))
def rollup_ties_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties across states that are merged: batches that share buckets and times."""
    rows = in_cents(tied_rows(spark, sf_dir)).withColumn("batch", F.pmod(F.col("sequence"), F.lit(3)))
    return as_double(ru.merge(ru.rollup(rows, [DAY_US], by=["batch"]).drop("batch")))


@register(f"SELECT {OHLC} FROM ({rollup_sql(EV, DAY_US)})")
def rollup_view_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlc(as_double(ru.rollup(in_cents(event_rows(spark, sf_dir)), [DAY_US])))


@register(rollup_sql(EV, DAY_US))
def rollup_coarsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(ru.coarsen(ru.rollup(in_cents(event_rows(spark, sf_dir)), [HOUR_US]), DAY_US))


@register(f"SELECT tenant, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, min(lo) AS low, max(hi) AS high FROM (SELECT tenant, {floor_to('timestamp_us', HOUR_US)} AS b, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total, min(value) AS lo, max(value) AS hi FROM {EV} GROUP BY ALL) GROUP BY tenant")
def rollup_reaggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ru.rollup(in_cents(event_rows(spark, sf_dir)), [HOUR_US])
    return states.groupBy("tenant").agg(
        F.sum("count").cast("bigint").alias("n"), F.sum("sum").cast("double").alias("total"), F.min("min").cast("double").alias("low"), F.max("max").cast("double").alias("high")
    )


@register(
    f"SELECT * FROM (SELECT count(*) AS raw_rows, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS raw_sum FROM {EV}) a CROSS JOIN "
    f"(SELECT CAST(sum(count) AS BIGINT) AS rolled_rows, CAST(sum(CAST(sum AS DECIMAL(18,2))) AS DOUBLE) AS rolled_sum FROM ({rollup_sql(EV, HOUR_US)})) b"
)
def raw_vs_rollup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_cents(event_rows(spark, sf_dir))
    raw = rows.agg(F.count("*").alias("raw_rows"), F.sum("value").cast("double").alias("raw_sum"))
    rolled = ru.rollup(rows, [HOUR_US]).agg(F.sum("count").cast("bigint").alias("rolled_rows"), F.sum("sum").cast("double").alias("rolled_sum"))
    return raw.crossJoin(rolled)  # one row each


@register(rollup_sql(EV, HOUR_US))
def rollup_incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that don't follow time, each rolled up alone, then merged."""
    rows = in_cents(event_rows(spark, sf_dir)).withColumn("batch", F.pmod(F.xxhash64("sequence", "ordinal"), F.lit(4)))
    return as_double(ru.merge(ru.rollup(rows, [HOUR_US], by=["batch"]).drop("batch")))


@register(f"SELECT bucket_us, tenant, series, count, sum, min, max, first, last, first_timestamp_us, last_timestamp_us FROM ({rollup_sql(EV, DAY_US, f'WHERE timestamp_us >= {THIRD}')})")
def rollup_backfill_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A width that is added after old rows have gone: states of the rows that are kept."""
    db = new_database(spark, sf_dir, "backfill", {"rollup_widths_us": [], "policy": {"retention_us": TWO_THIRDS - THIRD}})
    db.maintain(TWO_THIRDS)
    db.create_continuous_aggregate("daily", "events", DAY_US)
    v = db.rollups("events", width_us=DAY_US)
    return v.select("bucket_us", "tenant", "series", "count", F.round("sum", 2).alias("sum"), "min", "max", "first", "last", "first_timestamp_us", "last_timestamp_us")


@register(f"SELECT bucket_us, tenant, series, count, min, max, first, last FROM ({rollup_sql(EV, DAY_US)}) WHERE bucket_us + width_us > {THIRD}")
def rollup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = new_database(spark, sf_dir, "rollup_retention", {"rollup_widths_us": [DAY_US], "policy": {"rollup_retention_us": TWO_THIRDS - THIRD}})
    db.maintain(TWO_THIRDS)
    return db.rollups("events").select("bucket_us", "tenant", "series", "count", "min", "max", "first", "last")


SOUND = (
    "count > 0 AND first BETWEEN min AND max AND last BETWEEN min AND max AND first_timestamp_us <= last_timestamp_us AND (count > 1 OR first = last) "
    "AND first_timestamp_us BETWEEN bucket_us AND bucket_us + width_us - 1 AND last_timestamp_us BETWEEN bucket_us AND bucket_us + width_us - 1"
)


@register(" UNION ALL ".join(f"(SELECT width_us, count(*) AS states, count(*) FILTER (WHERE NOT ({SOUND})) AS broken FROM ({rollup_sql(EV, w)}) GROUP BY width_us)" for w in (MINUTE_US, DAY_US)))
def rollup_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ru.rollup(event_rows(spark, sf_dir), [MINUTE_US, DAY_US])
    return states.groupBy("width_us").agg(F.count("*").alias("states"), F.count(F.when(~ru.is_sound(), 1)).alias("broken"))


# -- scans, segments, lifecycle -----------------------------------------------------------------------------------


@register(f"SELECT timestamp_us, tenant, series, value, tags, sequence FROM {LOADED} WHERE tenant = 'view' AND timestamp_us >= {THIRD} AND timestamp_us < {TWO_THIRDS}")
def typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).scan("events", start_us=THIRD, end_us=TWO_THIRDS, tenant="view").drop("ordinal")


#: One step of the shard hash on two 32-bit halves, over ASCII characters; the products stay below 2**63.
FNV_STEP = "{'hi': (a.hi * 435 + (xor(a.lo, b) << 8) + ((xor(a.lo, b) * 435) >> 32)) & 4294967295, 'lo': (xor(a.lo, b) * 435) & 4294967295}"


def fnv_sql(tenant: str, series: str, shards: int) -> str:
    def framed(x: str) -> str:
        return f"list_concat([CAST(length({x}) AS BIGINT), 0, 0, 0, 0, 0, 0, 0], list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT)))"

    steps = f"list_concat({framed(tenant)}, {framed(series)})"
    begin = "{'hi': CAST(3421674724 AS BIGINT), 'lo': CAST(2216829733 AS BIGINT), 'b': CAST(0 AS BIGINT)}"
    items = f"list_concat([{begin}], list_transform({steps}, lambda v: {{'hi': CAST(0 AS BIGINT), 'lo': CAST(0 AS BIGINT), 'b': v}}))"
    step = FNV_STEP.replace(", b)", ", v.b)").replace("}", ", 'b': CAST(0 AS BIGINT)}")
    return f"(SELECT ((h.hi % {shards}) * (4294967296 % {shards}) + h.lo % {shards}) % {shards} FROM (SELECT list_reduce({items}, lambda a, v: {step}) AS h))"


@register(f"SELECT tenant, series, CAST({fnv_sql('tenant', 'series', 8)} AS BIGINT) AS shard FROM (SELECT DISTINCT tenant, series FROM {EV})")
def shard_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = event_rows(spark, sf_dir).select("tenant", "series").distinct()
    return keys.select("tenant", "series", shard_for(F.col("tenant"), F.col("series"), 8).alias("shard"))


@register(f"SELECT {floor_to('timestamp_us - ' + str(10**16), DAY_US)} AS window_us, count(*) AS n FROM {EV} GROUP BY ALL")
def event_window_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of times far before the epoch."""
    early = event_rows(spark, sf_dir).select(window_start(F.col("timestamp_us") - 10**16, DAY_US).alias("window_us"))
    return early.groupBy("window_us").agg(F.count("*").alias("n"))


def segment_sql(window_us: int) -> str:
    """Rows of each shard and window, of which segments of a window hold some."""
    shards = f"(SELECT tenant, series, CAST({fnv_sql('tenant', 'series', SHARDS)} AS BIGINT) AS shard FROM (SELECT DISTINCT tenant, series FROM {EV}))"
    return (
        f"SELECT shard, {floor_to('timestamp_us', window_us)} AS window_us, count(*) AS rows, min(timestamp_us) AS min_us, max(timestamp_us) AS max_us FROM {EV} JOIN {shards} USING (tenant, series) GROUP BY ALL"
    )


def segment_rows(spark: SparkSession, segments: list[dict]) -> DataFrame:
    """Segments of a manifest as rows, those of a shard and window as one."""
    rows = [(s["shard"], s["window"], s["rows"], s["min_us"], s["max_us"]) for s in segments]
    found = spark.createDataFrame(rows, "shard long, window_us long, n long, lo long, hi long")
    return found.groupBy("shard", "window_us").agg(F.sum("n").alias("rows"), F.min("lo").alias("min_us"), F.max("hi").alias("max_us"))


@register(segment_sql(5 * DAY_US))
def segment_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the database has written, by its manifest."""
    return segment_rows(spark, loaded(spark, sf_dir).segments("events"))


@register(f"SELECT * FROM ({segment_sql(5 * DAY_US)}) WHERE max_us < {TWO_THIRDS}")
def archive_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that the database would move; here a window's newest row decides, since one checkpoint wrote them."""
    db = new_database(spark, sf_dir, "archive", {"rollup_widths_us": [], "policy": {"archive_after_us": DAY_US}})
    db.checkpoint()
    old = set(db.archive_candidates("events", TWO_THIRDS + DAY_US))
    return segment_rows(spark, [s for s in db.segments("events") if s["file"] in old])


@register(
    f"SELECT shard, window_us, CAST(sum(1) AS BIGINT) AS files, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT {floor_to('timestamp_us', 5 * DAY_US)} AS window_us, "
    f"shard, sequence % 3 AS part, count(*) AS rows FROM {EV} JOIN (SELECT tenant, series, CAST({fnv_sql('tenant', 'series', SHARDS)} AS BIGINT) AS shard FROM (SELECT DISTINCT tenant, series FROM {EV})) USING (tenant, series) GROUP BY ALL) "
    "GROUP BY ALL HAVING count(*) >= 3"
)
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of small segments that three checkpoints have left."""
    db = database(spark, compact_min_segments=3)
    db.create_table("events", {"shards": SHARDS, "window_us": 5 * DAY_US, "rollup_widths_us": []})
    for part in range(3):
        db.write("events", f"part{part}", measured_rows(spark, sf_dir).where(F.col("sequence") % 3 == part).drop("sequence", "ordinal"), 0)
        db.checkpoint()
    found = [(g[0]["shard"], g[0]["window"], len(g), sum(s["rows"] for s in g)) for g in db.compaction_groups("events")]
    return spark.createDataFrame(found, "shard long, window_us long, files long, rows long")


@register(f"SELECT timestamp_us, tenant, series, value FROM {EV} WHERE timestamp_us >= {THIRD}")
def retention_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = new_database(spark, sf_dir, "retention", {"rollup_widths_us": [], "policy": {"retention_us": TWO_THIRDS - THIRD}})
    db.maintain(TWO_THIRDS)
    return db.rows("events").select("timestamp_us", "tenant", "series", "value")


# -- admission --------------------------------------------------------------------------------------------------------

#: Requests of a hundred rows each; every fifth comes twice, every tenth again with other rows.
REQUESTS = f"(SELECT sequence AS request, 0 AS copy, md5(string_agg(CAST(value AS VARCHAR), ',' ORDER BY ordinal)) AS digest, min(timestamp_us) AS least, count(*) AS rows FROM {EV} GROUP BY sequence)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    first = rows.groupBy(F.col("sequence").alias("request")).agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.col("value").cast("string").alias("v")))), lambda x: x["v"]), ",")).alias("digest"),
        F.min("timestamp_us").alias("least"),
        F.count("*").alias("rows"),
    )
    again = first.where("request % 5 = 0").withColumn("copy", F.lit(1))
    other = first.where("request % 10 = 0").withColumn("copy", F.lit(2)).withColumn("digest", F.md5("digest"))
    return first.withColumn("copy", F.lit(0)).unionByName(again).unionByName(other)


@register(
    f"WITH f AS {REQUESTS}, a AS (SELECT * FROM f UNION ALL SELECT request, 1, digest, least, rows FROM f WHERE request % 5 = 0 UNION ALL SELECT request, 2, md5(digest), least, rows FROM f WHERE request % 10 = 0) "
    "SELECT a.request, a.copy, CASE WHEN a.copy = 0 THEN 'accepted' WHEN a.digest = f.digest THEN 'duplicate' ELSE 'conflict' END AS outcome FROM a JOIN f USING (request)"
)
def dedupe_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admit(_requests(spark, sf_dir)).select("request", "copy", "outcome")


@register(f"SELECT sequence AS request, count(*) AS rows, min(timestamp_us) >= {THIRD} AS admitted FROM {EV} GROUP BY sequence")
def lateness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole batches, by their oldest row."""
    batches = event_rows(spark, sf_dir).groupBy(F.col("sequence").alias("request")).agg(F.count("*").alias("rows"), F.min("timestamp_us").alias("least"))
    return batches.select("request", "rows", (F.col("least") >= THIRD).alias("admitted"))


@register(
    f"SELECT sequence AS request, CASE WHEN least < {THIRD} THEN 'expired' WHEN least > {TWO_THIRDS} THEN 'future' ELSE 'valid' END AS outcome FROM (SELECT sequence, min(timestamp_us) AS least FROM {EV} GROUP BY sequence) "
    f"UNION ALL SELECT -sequence, 'malformed' FROM {EV} GROUP BY sequence"
)
def timed_id_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    ids = rows.groupBy(F.col("sequence").alias("request")).agg(F.concat(F.lit("v1:"), F.min("timestamp_us").cast("string"), F.lit(":n")).alias("request_id"))
    odd = ids.select((-F.col("request")).alias("request"), F.regexp_replace("request_id", "^v1", "v2").alias("request_id"))
    return timed_ids(ids.unionByName(odd), F.lit(THIRD), F.lit(TWO_THIRDS)).select("request", "outcome")


#: Six batches of five days each.
BATCHES = f"(SELECT (timestamp_us - 1704067200000000) // {5 * DAY_US} AS batch, count(*) AS rows, min(timestamp_us) AS least FROM {EV} GROUP BY ALL)"


@register(
    f"SELECT batch, attempt, CASE WHEN least < {THIRD} THEN 'refused' WHEN attempt = 'first' THEN 'accepted' WHEN attempt = 'again' THEN 'duplicate' ELSE 'refused' END AS outcome, "
    f"CASE WHEN least < {THIRD} OR attempt = 'other' THEN 0 ELSE rows END AS rows FROM {BATCHES} CROSS JOIN (VALUES ('first'), ('again'), ('other')) t(attempt)"
)
def database_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the database answers: each batch three times, at last with other rows under the same id."""
    db = database(spark)
    db.create_table("events", {"shards": SHARDS, "window_us": 5 * DAY_US, "rollup_widths_us": [], "policy": {"late_after_us": TWO_THIRDS - THIRD}})
    rows, out = measured_rows(spark, sf_dir), []
    for batch in range(6):
        low = 1704067200000000 + batch * 5 * DAY_US
        part = rows.where((F.col("timestamp_us") >= low) & (F.col("timestamp_us") < low + 5 * DAY_US)).drop("sequence", "ordinal")
        for attempt in ("first", "again", "other"):
            sent = part.withColumn("value", F.col("value") + 1) if attempt == "other" else part
            try:
                receipt = db.write("events", f"batch{batch}", sent, TWO_THIRDS)
                out.append((batch, attempt, "duplicate" if receipt["duplicate"] else "accepted", receipt["rows"]))
            except Rejected:
                out.append((batch, attempt, "refused", 0))
    return spark.createDataFrame(out, "batch long, attempt string, outcome string, rows long")


@register(
    f"SELECT problem, count(*) AS n FROM (SELECT CASE WHEN ordinal % 10 = 1 THEN 'value' WHEN ordinal % 10 = 2 THEN 'tenant' WHEN ordinal % 10 = 3 THEN 'series' ELSE 'none' END AS problem FROM {EV}) GROUP BY problem"
)
def validation_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.col("ordinal") % 10
    spoilt = event_rows(spark, sf_dir).select(
        "timestamp_us",
        F.when(digit == 2, F.repeat(F.lit("é"), 129)).otherwise(F.col("tenant")).alias("tenant"),
        F.when(digit == 3, "").otherwise(F.col("series")).alias("series"),
        F.when(digit == 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
        F.from_json("tags", "map<string,string>").alias("tags"),
    )
    return row_checks(spoilt).groupBy("problem").agg(F.count("*").alias("n"))


# -- joins that need more than a word -------------------------------------------------------------------------------


@register(f"SELECT a.timestamp_us, a.series, a.value, b.value AS seen FROM (SELECT * FROM {EV} WHERE tenant = 'purchase') a ASOF LEFT JOIN (SELECT * FROM {EV} WHERE tenant = 'view') b ON a.series = b.series AND a.timestamp_us >= b.timestamp_us")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    left = rows.where("tenant = 'purchase'").select("timestamp_us", "series", "value")
    right = rows.where("tenant = 'view'").select("series", "timestamp_us", F.col("value").alias("seen"))
    return asof_join(left, right, ["series"], "timestamp_us", "timestamp_us", ["seen"])


@register(f"SELECT a.series, a.timestamp_us, b.timestamp_us AS before_us FROM (SELECT * FROM {EV} WHERE tenant = 'purchase') a JOIN (SELECT * FROM {EV} WHERE tenant = 'click') b ON a.series = b.series AND b.timestamp_us BETWEEN a.timestamp_us - 3 * {DAY_US} AND a.timestamp_us")
def join_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    left = rows.where("tenant = 'purchase'").select("series", "timestamp_us")
    right = rows.where("tenant = 'click'").select("series", F.col("timestamp_us").alias("before_us"))
    return band_join(left, right, ["series"], F.col("timestamp_us"), F.col("before_us"), 3 * DAY_US)


# -- the database, end to end ---------------------------------------------------------------------------------------


def database(spark: SparkSession, **settings: int) -> Database:
    """A new database in the folder that executors share; in a folder of this machine only where executors run in this process."""
    context = spark.sparkContext
    shared = context._jsc.sc().getCheckpointDir()
    base = shared.get() if shared.isDefined() else context.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that executors share")
        base = tempfile.mkdtemp(prefix="database-")
    return Database(spark, f"{base}/database-{uuid.uuid4().hex}", **settings)


def measured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).withColumn("tags", F.from_json("tags", "map<string,string>"))


def new_database(spark: SparkSession, sf_dir: str, request: str, settings: dict) -> Database:
    """The events as one batch of a new table."""
    db = database(spark)
    db.create_table("events", {"shards": SHARDS, "window_us": 5 * DAY_US} | settings)
    db.write("events", request, measured_rows(spark, sf_dir).drop("sequence", "ordinal"), 0)
    return db


_LOADED: dict[tuple[str, str], Database] = {}


def loaded(spark: SparkSession, sf_dir: str) -> Database:
    """The events dealt into segments, with rollups of a minute, an hour and a day; loaded once for all queries of an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _LOADED:
        db = new_database(spark, sf_dir, "load", {"rollup_widths_us": [MINUTE_US, DAY_US]})
        db.checkpoint()
        db.create_continuous_aggregate("hourly", "events", HOUR_US)
        _LOADED[key] = db
    return _LOADED[key]


@register(f"SELECT timestamp_us, tenant, series, value FROM {EV} WHERE tenant = 'view' AND timestamp_us >= {TWO_THIRDS}")
def database_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).scan("events", start_us=TWO_THIRDS, tenant="view").select("timestamp_us", "tenant", "series", "value")


@register(f"SELECT bucket_us, tenant, series, tags, count, sum, average, min, max, first, last, first_timestamp_us, last_timestamp_us FROM (SELECT *, round(sum / count, 4) AS average FROM ({rollup_sql(LOADED, HOUR_US)}))")
def database_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query(
        "SELECT bucket_us, tenant, series, tags, count, round(sum, 2) AS sum, round(average, 4) AS average, min, max, first, last, first_timestamp_us, last_timestamp_us FROM hourly"
    )


@register(f"SELECT tenant, count(*) AS n, max(value) AS high FROM {EV} WHERE timestamp_us >= {THIRD} AND timestamp_us < {TWO_THIRDS} GROUP BY tenant")
def database_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query(f"SELECT tenant, count(*) AS n, max(value) AS high FROM events WHERE timestamp_us >= {THIRD} AND timestamp_us < {TWO_THIRDS} GROUP BY tenant")


#: Predicates by which files may be pruned, or mustn't be.
PREDICATES = {
    "range": f"timestamp_us >= {THIRD} AND timestamp_us < {TWO_THIRDS}",
    "between": f"timestamp_us BETWEEN {THIRD} AND {TWO_THIRDS}",
    "turned": f"{THIRD} <= timestamp_us AND {TWO_THIRDS} > timestamp_us",
    "series": f"tenant = 'view' AND series = 'user_7' AND timestamp_us > {THIRD}",
    "or": f"timestamp_us < {THIRD} OR timestamp_us >= {TWO_THIRDS}",
    "not": f"NOT (timestamp_us > {THIRD})",
    "words": f"(tenant = 'x AND timestamp_us >= {TWO_THIRDS} AND y' OR timestamp_us < {THIRD})",
    "null": f"((timestamp_us >= {TWO_THIRDS}) AND (value > 1)) IS NOT NULL AND tenant = 'view'",
    "case": f"CASE WHEN timestamp_us >= {TWO_THIRDS} THEN tenant = 'click' ELSE tenant = 'view' END",
    "computed": f"timestamp_us + 1 > {TWO_THIRDS}",
    "in": "tenant IN ('view', 'click') AND series IN ('user_7', 'user_9')",
}


def _predicate(name: str, where: str) -> None:
    text = f"SELECT timestamp_us, tenant, series, value FROM {{}} WHERE {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loaded(spark, sf_dir).query(text.format("events"))

    QUERIES[f"database_where_{name}"] = run
    ORACLES[f"database_where_{name}"] = text.format(EV)


for _name, _where in PREDICATES.items():
    _predicate(_name, _where)


@register(f"SELECT timestamp_us, rn FROM (SELECT timestamp_us, row_number() OVER (ORDER BY timestamp_us) AS rn FROM {EV} WHERE tenant = 'click' AND series = 'user_7') WHERE timestamp_us >= {THIRD}")
def database_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over a window prunes no files below it."""
    inner = "SELECT timestamp_us, CAST(row_number() OVER (ORDER BY timestamp_us) AS BIGINT) AS rn FROM events WHERE tenant = 'click' AND series = 'user_7'"
    return loaded(spark, sf_dir).query(f"SELECT timestamp_us, rn FROM ({inner}) WHERE timestamp_us >= {THIRD}")


@register(
    f"SELECT tenant, epoch_us(time_bucket(INTERVAL '6 hours', make_timestamp(timestamp_us))) AS bucket_us, arg_min(value, timestamp_us) AS f, strftime(max(make_timestamp(timestamp_us)), '%Y-%m-%d %H:%M:%S') AS newest, "
    f"date_diff('day', min(make_timestamp(timestamp_us)), make_timestamp({TWO_THIRDS})) AS days, approx_count_distinct(tenant) AS kinds FROM {EV} WHERE timestamp_us < {TWO_THIRDS} GROUP BY ALL"
)
def database_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the users' dialect."""
    time = "to_timestamp(timestamp_us / 1000000)"
    return loaded(spark, sf_dir).query(
        f"SELECT tenant, epoch_us(time_bucket(INTERVAL '6' HOUR, {time})) AS bucket_us, arg_min(value, timestamp_us) AS f, strftime(max({time}), '%Y-%m-%d %H:%M:%S') AS newest, "
        f"date_diff('day', min({time}), to_timestamp({TWO_THIRDS // 1_000_000})) AS days, approx_count_distinct(tenant) AS kinds FROM events WHERE timestamp_us < {TWO_THIRDS} GROUP BY tenant, epoch_us(time_bucket(INTERVAL '6' HOUR, {time}))"
    )


@register(f"SELECT tenant, NULL AS series, count(*) AS n FROM {EV} GROUP BY tenant UNION ALL BY NAME SELECT count(*) AS n, series FROM {EV} GROUP BY series")
def database_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("SELECT tenant, count(*) AS n FROM events GROUP BY tenant UNION ALL BY NAME SELECT count(*) AS n, series FROM events GROUP BY series")


@register(f"SELECT 'events' AS name, CAST(4 AS DECIMAL(20,0)) AS shards, CAST({5 * DAY_US} AS BIGINT) AS window_us, CAST(1 AS DECIMAL(20,0)) AS created_sequence")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(spark, sf_dir).query("SELECT * FROM ts_tables()")


@register(
    "SELECT * FROM (VALUES ('events', CAST(5 AS BIGINT), CAST(NULL AS BIGINT), CAST(7 AS BIGINT), CAST(NULL AS BIGINT), CAST(50 AS BIGINT), CAST(150 AS BIGINT)), "
    "('other', NULL, NULL, NULL, NULL, NULL, NULL)) t(table_name, late_after_us, retention_us, archive_after_us, rollup_retention_us, idempotency_window_us, idempotency_floor_us)"
)
def catalog_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.create_table("events")
    db.create_table("other")
    db.query("CALL ts_set_policy('events', '{\"late_after_us\": 5, \"archive_after_us\": 7, \"idempotency_window_us\": 50}')", now_us=200)
    return db.query("SELECT * FROM ts_policies()")


@register(f"SELECT * FROM (VALUES ('daily', 'events', CAST({DAY_US} AS BIGINT), CAST(3 AS DECIMAL(20,0))), ('hourly', 'events', CAST({HOUR_US} AS BIGINT), CAST(2 AS DECIMAL(20,0)))) t(name, source, width_us, created_sequence)")
def catalog_continuous_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark)
    db.create_table("events")
    for name, width in (("hourly", HOUR_US), ("daily", DAY_US), ("gone", MINUTE_US)):
        db.query(f"CALL ts_create_continuous_aggregate('{name}', 'events', {width})")
    db.query("CALL ts_drop_continuous_aggregate('gone')")
    return db.query("SELECT * FROM ts_continuous_aggregates()")


@register(
    "SELECT * FROM (VALUES ('bad', 'ship', CAST(60000000 AS BIGINT), false, CAST(1000020 AS BIGINT), false, 1, 1, false), ('cp', 'checkpoint', 10, true, 10, false, 0, NULL, NULL), "
    "('good', 'checkpoint', 10, false, 30, false, 0, 1, true)) t(name, kind, interval_us, paused, next_run_us, running, attempts, latest_run_id, latest_success)"
)
def catalog_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job that has succeeded, one that has failed, one paused."""
    db = database(spark)
    for name, kind, interval in (("cp", "checkpoint", 10), ("good", "checkpoint", 10), ("bad", "ship", 60_000_000)):
        db.query(f"CALL ts_create_job('{name}', '{kind}', {interval})")
    db.query("CALL ts_pause_job('cp')")
    for name in ("good", "bad"):
        db.query(f"CALL ts_run_job('{name}')", now_us=20)
    return db.query(
        "SELECT name, kind, interval_us, paused, next_run_us, running, CAST(attempts AS INT) AS attempts, CAST(latest_run_id AS INT) AS latest_run_id, latest_success FROM ts_jobs() WHERE name <> 'maintenance'"
    )


@register(f"SELECT CAST(1 AS BIGINT) AS tables, CAST(2 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS checkpoint_sequence, CAST(0 AS BIGINT) AS remote_sequence, CAST(2 AS BIGINT) AS unshipped_batches, count(*) AS hot_rows, count(*) > 0 AS has_bytes, true AS healthy FROM {EV}")
def catalog_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = new_database(spark, sf_dir, "status", {"rollup_widths_us": []})
    names = ("tables", "sequence", "checkpoint_sequence", "remote_sequence", "unshipped_batches", "hot_rows")
    return db.query(f"SELECT {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)}, hot_bytes > 0 AND metadata_bytes > 0 AND wal_bytes > 0 AS has_bytes, healthy FROM ts_status()")


# -- statements that both engines read alike ------------------------------------------------------------------------


def statement(name: str, spark_sql: str, duck_sql: str | None = None, tables: str = "") -> None:
    """Registers a Spark SQL text; {ev} and {sh} stand for measurements, other tables go by their names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = {t: table(spark, sf_dir, t) for t in tables.split()}
        if "{ev}" in spark_sql:
            views["ev"] = event_rows(spark, sf_dir)
        if "{sh}" in spark_sql:
            views["sh"] = ship_rows(spark, sf_dir)
        return spark.sql(spark_sql.format(**{t: "{" + t + "}" for t in views}), **views)

    run.__name__ = name
    QUERIES[name] = run
    if duck_sql != "":
        text = spark_sql if duck_sql is None else duck_sql
        ORACLES[name] = text.format(ev=EV, sh=SH, **{t: t for t in tables.split()})


from tidemark import statements  # noqa: E402,F401  - registers the statements
