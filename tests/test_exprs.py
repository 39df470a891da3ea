from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.exprs import shard_for, tags_json, window_start
from tidemark.plans.prune import shard_of
from tidemark.model import MEASUREMENT, Rejected, TableConfig, check_name, check_request_id, row_problem


def fnv(tenant: str, series: str, shards: int) -> int:
    h = 0xCBF29CE484222325
    for text in (tenant.encode(), series.encode()):
        for b in len(text).to_bytes(8, "little") + text:
            h = (h ^ b) * 0x100000001B3 % 2**64
    return h % shards


def test_shards(spark):
    keys = [("tenant", "cpu", 8), ("ab", "c", 1024), ("a", "bc", 1024), ("東京", "é" * 40, 1000), ("", "x", 3)]
    got = spark.createDataFrame(keys, "t string, s string, n int").select("t", "s", "n", shard_for(F.col("t"), F.col("s"), F.col("n")).alias("shard")).collect()
    assert [r.shard for r in got] == [fnv(*k) for k in keys]
    assert [r.shard for r in got][:3] == [2, 726, 234]
    assert [shard_of(*k) for k in keys] == [fnv(*k) for k in keys]


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 1000, 1024])
def test_shards_of_literal_numbers(spark, shards):
    """Powers of two take the low half alone: a state of one number, not of a struct."""
    keys = [("tenant", "cpu"), ("東京", "é" * 400), ("", "x\0y"), ("t" * 256, ""), ("a", "b" * 70_000)]
    rows = spark.createDataFrame(keys, "t string, s string")
    got = rows.select(shard_for(F.col("t"), F.col("s"), shards).alias("shard"))
    assert [r.shard for r in got.collect()] == [fnv(*k, shards) for k in keys]
    assert ("struct" in got._jdf.queryExecution().analyzed().toString()) == (shards & (shards - 1) > 0)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**60), 2**60), st.integers(1, 10**15)), min_size=1, max_size=30))
def test_windows_floor(spark, pairs):
    df = spark.createDataFrame(pairs, "t long, w long")
    assert [r[0] for r in df.select(window_start(F.col("t"), F.col("w"))).collect()] == [t // w * w for t, w in pairs]


def test_window_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        spark.createDataFrame([(-(2**63),)], "t long").select(window_start(F.col("t"), 10)).collect()


def test_tags_are_canonical(spark):
    df = spark.createDataFrame([({"b": "2", "a": 'x"y'},), ({},), (None,)], "tags map<string,string>")
    assert [r[0] for r in df.select(tags_json(F.col("tags"))).collect()] == ['{"a":"x\\"y","b":"2"}', "{}", "{}"]


@pytest.mark.parametrize("name", ["", "x__rollup", "../x", "UPPER", "1x", "a-b", "a" * 64])
def test_bad_names(name):
    with pytest.raises(Rejected):
        check_name(name)


def test_settings_are_strict():
    for bad in ({"shards": 0}, {"shards": 1025}, {"window_us": 0}, {"rollup_widths_us": [1, 1]}, {"rollup_widths_us": list(range(1, 18))}, {"policy": {"late_after_us": 0}}, {"other": 1}):
        with pytest.raises(Rejected):
            TableConfig.of(bad)
    with pytest.raises(Rejected):
        check_request_id("x" * 257)


def test_row_problems(spark):
    rows = [
        (1, "t", "s", 1.0, {}), (1, "t", "s", float("inf"), {}), (1, "t", "s", float("nan"), {}), (1, "é" * 129, "s", 1.0, {}), (1, "a\0", "s", 1.0, {}),
        (1, "t", "", 1.0, None), (1, "t", "s", 1.0, {str(i): "" for i in range(33)}), (1, "t", "s", 1.0, {"k" * 129: ""}), (1, "t", "s", 1.0, {"": ""}),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, MEASUREMENT).select(row_problem()).collect()]
    assert got == [None, "value", "value", "tenant", "tenant", "series", "tags", "tags", "tags"]
