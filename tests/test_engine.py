"""The database's rules, batch by batch."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.engine import MAINTENANCE, Database
from tidemark.model import Rejected, TableConfig
from tidemark.operators import rollup as ru
from tidemark.sources import segments


def row(ts, value=1.0, tenant="tenant", series="cpu", tags=None):
    return {"timestamp_us": ts, "tenant": tenant, "series": series, "value": float(value), "tags": tags or {}}


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


def times(db, **bounds):
    return [r.timestamp_us for r in db.scan("metrics", **bounds).orderBy("timestamp_us", "ordinal").collect()]


def test_idempotent_batches(db):
    assert db.create_table("metrics", TableConfig(shards=1, window_us=100, rollup_widths_us=[10])) == 1
    assert db.create_table("metrics", TableConfig(shards=1, window_us=100, rollup_widths_us=[10])) == 1
    with pytest.raises(Rejected):
        db.create_table("metrics", TableConfig(shards=2))
    batch = [row(2, 2), row(1, 1), row(2, 3)]
    first = db.write("metrics", "batch", batch, 0)
    assert db.write("metrics", "batch", batch, 100_000) == first | {"duplicate": True}
    with pytest.raises(Rejected):
        db.write("metrics", "batch", batch[:2], 0)
    before = db.sequence
    with pytest.raises(Rejected):
        db.write("metrics", "other", [row(3), row(4, float("nan"))], 0)
    with pytest.raises(Rejected):
        db.write("metrics", "none", [], 0)
    assert db.sequence == before
    (r,) = db.rollups("metrics").collect()
    assert (r["count"], r["sum"], r["first"], r["last"], r["average"]) == (3, 6.0, 1.0, 3.0, 2.0)


def test_retention_and_no_resurrection(db):
    db.create_table("metrics", {"shards": 1, "window_us": 10, "rollup_widths_us": [10], "policy": {"retention_us": 25, "late_after_us": 100}})
    db.write("metrics", "a", [row(t) for t in (-11, -10, -1, 0, 1, 11)], 20)
    assert db.maintain(20)["expired_rows"] == 2
    assert times(db) == [-1, 0, 1, 11]
    assert db.rollups("metrics").agg(F.sum("count")).first()[0] == 6
    for name, t in (("late", -81), ("resurrect", -10)):
        with pytest.raises(Rejected):
            db.write("metrics", name, [row(t)], 20)
    assert db.write("metrics", "a", [row(t) for t in (-11, -10, -1, 0, 1, 11)], 1000)["duplicate"]
    db.maintain(10)
    assert times(db) == [-1, 0, 1, 11]


def test_rollup_retention_and_overflow(db):
    db.create_table("metrics", {"shards": 1, "window_us": 100, "rollup_widths_us": [10], "policy": {"rollup_retention_us": 15}})
    db.write("metrics", "a", [row(t) for t in (1, 10, 20)], 0)
    db.maintain(25)
    assert db.rollups("metrics").count() == 2
    db.write("metrics", "late", [row(1)], 25)
    assert db.rollups("metrics").count() == 2 and len(times(db)) == 4
    db.write("metrics", "big", [row(50, 1.7e308)], 25)
    before = db.sequence
    with pytest.raises(Rejected):
        db.write("metrics", "bigger", [row(51, 1.7e308)], 25)
    assert db.sequence == before


def test_group_commit(db):
    db.create_table("a", {"rollup_widths_us": [10]})
    db.create_table("other", {"rollup_widths_us": [10]})
    group = [("a", "a", [row(2, 2)]), ("none", "x", [row(1)]), ("a", "a", [row(2, 2)]), ("a", "a", [row(2, 9)]), ("a", "b", [row(1, 1)]), ("other", "o", [row(5)]), ("a", "c", [row(2, 3)])]
    got = db.write_group(group, 0)
    assert [isinstance(g, Rejected) for g in got] == [False, True, False, True, False, False, False]
    assert got[2]["duplicate"] and len({g["sequence"] for g in got if isinstance(g, dict)}) == 1
    placed = {(r.sequence, r.ordinal) for t in ("a", "other") for r in db.rows(t).collect()}
    assert len(placed) == 4
    (r,) = db.rollups("a").collect()
    assert (r["count"], r["sum"], r["first"], r["last"]) == (3, 6.0, 1.0, 3.0)


def test_timed_request_ids(db):
    db.create_table("metrics", {"policy": {"idempotency_window_us": 100}})
    now = 10**9
    db.write("metrics", f"v1:{now}:a", [row(1)], now)
    for bad in ("plain", f"v1:{now - 101}:b", f"v1:{now + 300_000_001}:c"):
        with pytest.raises(Rejected):
            db.write("metrics", bad, [row(1)], now)
    db.maintain(now + 500)
    with pytest.raises(Rejected):
        db.write("metrics", f"v1:{now}:a", [row(1)], now + 500)
    assert db.idempotency_floor_us("metrics", now) == now + 400
    with pytest.raises(Rejected):
        db.set_policy("metrics", {})


def test_continuous_aggregates(db):
    db.create_table("metrics", {"rollup_widths_us": [10]})
    db.write("metrics", "a", [row(1, 1), row(11, 2)], 0)
    db.create_continuous_aggregate("fives", "metrics", 5)
    assert db.rollups("metrics", width_us=5).count() == 2
    db.write("metrics", "late", [row(3, 4)], 0)
    assert db.query("SELECT CAST(sum(count) AS BIGINT) AS n FROM fives").first().n == 3
    db.create_continuous_aggregate("also", "metrics", 5)
    db.drop_continuous_aggregate("fives")
    assert db.rollups("metrics", width_us=5).count() == 2
    db.drop_continuous_aggregate("also")
    assert db.rollups("metrics", width_us=5).count() == 0 and db.rollups("metrics", width_us=10).count() == 2
    db.create_continuous_aggregate("tens", "metrics", 10)
    db.drop_continuous_aggregate("tens")
    assert db.rollups("metrics", width_us=10).count() == 2
    with pytest.raises(Rejected):
        db.create_continuous_aggregate("metrics", "metrics", 7)


def test_compaction_archive_and_garbage(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), compact_min_segments=3)
    db.create_table("metrics", {"shards": 1, "window_us": 1000, "policy": {"archive_after_us": 100}})
    for i in range(3):
        db.write("metrics", f"r{i}", [row(i)], 0)
        db.checkpoint()
    assert len(db.compaction_groups("metrics")) == 1 and len(db.archive_candidates("metrics", 1000)) == 3
    assert db.compact() == 1 and db.compact() == 0
    assert times(db) == [0, 1, 2] and db.collect_garbage() == 0 and db.collect_garbage(0) > 0 and times(db) == [0, 1, 2]


def test_archived_segments_stay_readable(db, tmp_path):
    db.create_table("metrics", {"shards": 1, "window_us": 10, "policy": {"archive_after_us": 100}})
    db.write("metrics", "a", [row(t) for t in (0, 15, 990)], 0)
    db.checkpoint()
    assert db.archive(1000, str(tmp_path / "old")) == 2 and db.archive(1000, str(tmp_path / "old")) == 0
    assert db.collect_garbage(0) >= 2 and times(db) == [0, 15, 990]


def test_ship_and_restore(spark, db, tmp_path):
    db.create_table("metrics")
    db.write("metrics", "a", [row(1), row(2)], 0)
    remote = str(tmp_path / "remote")
    db.ship(remote)
    copy = Database.restore(spark, remote, str(tmp_path / "copy"))
    assert copy.scan("metrics").count() == 2 and copy.rollups("metrics").count() == db.rollups("metrics").count()
    assert copy.write("metrics", "a", [row(1), row(2)], 0)["duplicate"]
    with pytest.raises(Rejected):
        Database.restore(spark, remote, str(tmp_path / "copy"))


def test_two_writers(spark, db):
    other = Database(spark, db.store.root)
    db.create_table("metrics")
    with pytest.raises(Rejected):
        other.create_table("metrics2")


def test_jobs(db):
    db.create_job("cp", "checkpoint", 10, 0)
    assert MAINTENANCE in db.jobs()
    db.pause_job(MAINTENANCE)
    assert db.tick(9) == [] and db.tick(10) == ["cp"]
    db.pause_job("cp")
    assert db.tick(100) == [] and db.run_job_now("cp", 100)
    db.create_job("bad", "ship", 60_000_000, 0)
    assert not db.run_job_now("bad", 100)
    job = db.jobs()["bad"]
    assert (job["attempts"], job["success"], job["next_run_us"]) == (1, False, 100 + 1_000_000)
    assert db.tick(job["next_run_us"] - 1) == [] and db.tick(job["next_run_us"]) == ["bad"] and db.jobs()["bad"]["attempts"] == 2
    with pytest.raises(Rejected):
        db.drop_job(MAINTENANCE)
    db.drop_job("cp")
    assert "cp" not in db.jobs()


def test_sql(db):
    db.create_table("metrics", {"shards": 4, "window_us": 10, "rollup_widths_us": [10]})
    db.write("metrics", "a", [row(t, t, tenant=n) for t, n in ((-10, "a"), (-1, "A"), (0, "O'Brien"), (9, "a"), (10, "東京"), (11, "a"))], 0)
    db.checkpoint()
    db.write("metrics", "late", [row(1, 1, tenant="a", series="disk")], 0)
    everything = db.rows("metrics").collect()
    for where, keep in (
        ("timestamp_us >= 0 AND timestamp_us < 10", lambda r: 0 <= r.timestamp_us < 10),
        ("timestamp_us BETWEEN -1 AND 1", lambda r: -1 <= r.timestamp_us <= 1),
        ("tenant = 'a' AND series = 'cpu'", lambda r: (r.tenant, r.series) == ("a", "cpu")),
        ("tenant = 'O''Brien'", lambda r: r.tenant == "O'Brien"),
        ("tenant = 'a' AND tenant = 'A'", lambda r: False),
        ("timestamp_us < 0 OR timestamp_us > 10", lambda r: r.timestamp_us < 0 or r.timestamp_us > 10),
        ("NOT timestamp_us > 0", lambda r: not r.timestamp_us > 0),
        ("timestamp_us >= 10 AND timestamp_us < 10", lambda r: False),
    ):
        got = db.query(f"SELECT * FROM metrics WHERE {where}").collect()
        assert sorted(got) == sorted(r for r in everything if keep(r)), where
    nested = db.query("SELECT tenant, rn FROM (SELECT tenant, timestamp_us, row_number() OVER (ORDER BY timestamp_us) AS rn FROM metrics) WHERE timestamp_us >= 9 ORDER BY rn")
    assert [r.rn for r in nested.collect()] == [5, 6, 7]
    assert db.query('SELECT "name" FROM ts_tables()').first()[0] == "metrics"
    assert db.query("SELECT count(*) FROM ts_jobs()").first()[0] == 1
    assert db.query("EXPLAIN SELECT 1").columns == ["plan"]
    db.query(f"CALL ts_set_policy('metrics', '{json.dumps({'late_after_us': 5})}')")
    assert db.policy("metrics").late_after_us == 5
    for bad in ("CALL ts_drop_job('x'); SELECT 1", "CALL ts_set_policy('metrics', lower('{}'))", "CALL other()"):
        before = db.sequence
        with pytest.raises(Rejected):
            db.query(bad)
        assert db.sequence == before


def test_files_are_pruned(db):
    db.create_table("metrics", {"shards": 1, "window_us": 10, "rollup_widths_us": []})
    db.write("metrics", "a", [row(t) for t in range(0, 100, 10)], 0)
    db.checkpoint()
    read = db.query("SELECT * FROM metrics WHERE timestamp_us >= 40 AND timestamp_us < 60").inputFiles()
    assert len(read) == 2
    assert len(db.scan("metrics", 40, 60).inputFiles()) == 2


def test_workload_against_a_plain_model(db):
    rnd, expected = random.Random(7), []
    db.create_table("metrics", {"shards": 4, "window_us": 20, "rollup_widths_us": [10, 50]})
    for i in range(8):
        batch = [row(rnd.randint(-99, 99), rnd.randint(0, 99), series=rnd.choice("xyz")) for _ in range(5)]
        db.write("metrics", f"r{i}", batch, 0)
        expected += [(r["timestamp_us"], r["series"], r["value"]) for r in batch]
        if i % 3 == 2:
            db.checkpoint()
    assert sorted((r.timestamp_us, r.series, r.value) for r in db.rows("metrics").collect()) == sorted(expected)
    states = db.rollups("metrics")
    for width in (10, 50):
        sums: dict = {}
        for t, s, v in expected:
            sums[t // width * width, s] = sums.get((t // width * width, s), 0) + v
        assert {(r.bucket_us, r.series): r["sum"] for r in states.where(F.col("width_us") == width).collect()} == sums
    assert ru.broken(states).count() == 0
    again = Database(db.spark, db.store.root)
    assert again.sequence == db.sequence and again.rows("metrics").count() == len(expected)


def test_literals_that_look_like_conditions_prune_nothing(db):
    db.create_table("metrics", {"shards": 4, "window_us": 10, "rollup_widths_us": []})
    odd = "x AND timestamp_us >= 99 AND y"
    db.write("metrics", "a", [row(t, t, tenant=n) for t in range(0, 60, 10) for n in (odd, "a OR b", "NOT (c)", r"d\'e", "a")], 0)
    db.checkpoint()
    everything = db.rows("metrics").collect()
    for where, keep in (
        (f"tenant = '{odd}'", lambda r: r.tenant == odd),
        (f"tenant = '{odd}' AND timestamp_us < 30", lambda r: r.tenant == odd and r.timestamp_us < 30),
        ("tenant = 'a OR b' AND series = 'cpu'", lambda r: r.tenant == "a OR b"),
        ("tenant = 'NOT (c)' AND timestamp_us > 20", lambda r: r.tenant == "NOT (c)" and r.timestamp_us > 20),
        (r"tenant = 'd\''e'", lambda r: r.tenant == r"d\'e"),
        ("((timestamp_us >= 50) AND (value > 1)) IS NULL", lambda r: False),
        ("((timestamp_us >= 50) AND (value > 1)) IS NOT NULL", lambda r: True),
        ("(timestamp_us >= 50 AND value > 1) = false", lambda r: not (r.timestamp_us >= 50 and r.value > 1)),
        ("CASE WHEN timestamp_us >= 50 THEN true ELSE value < 20 END", lambda r: r.timestamp_us >= 50 or r.value < 20),
        ("30 <= timestamp_us AND 40 > timestamp_us", lambda r: 30 <= r.timestamp_us < 40),
        ("timestamp_us + 10 >= 50", lambda r: r.timestamp_us >= 40),
        ("timestamp_us IN (10, 50)", lambda r: r.timestamp_us in (10, 50)),
    ):
        got = db.query(f"SELECT * FROM metrics WHERE {where}").collect()
        assert sorted(got) == sorted(r for r in everything if keep(r)), where
    renamed = db.query("SELECT timestamp_us FROM (SELECT value AS timestamp_us, timestamp_us AS t FROM metrics) WHERE timestamp_us >= 50")
    assert renamed.count() == 5
    both = db.query("SELECT count(*) AS n FROM metrics a JOIN metrics b ON a.tenant = b.tenant WHERE a.timestamp_us = 0 AND b.timestamp_us = 50")
    assert both.first().n == 5 and len(both.inputFiles()) <= len(db.rows("metrics").inputFiles())


def test_writes_do_not_read_history(db, spark):
    db.create_table("metrics", {"rollup_widths_us": [10]})
    for i in range(3):
        db.write("metrics", f"r{i}", [row(i)], 0)
    t = db.state["tables"]["metrics"]
    assert len(t["deltas"]) == 3 and t["weight"] == 3.0 and [h["rows"] for h in t["hot"]] == [1, 1, 1]
    assert db.rollups("metrics", start_us=100).count() == 0 and db.rollups("metrics", start_us=0, end_us=1).first()["count"] == 3
    before = {n for n, _ in db.store.files("hot")}
    with pytest.raises(Rejected):
        db.write("metrics", "r9", [row(1), row(2, float("inf"))], 0)
    assert {n for n, _ in db.store.files("hot")} == before


def test_maintenance_with_a_remote_store(spark, db, tmp_path):
    remote = str(tmp_path / "remote")
    db.create_table("metrics", {"shards": 1, "window_us": 10, "policy": {"archive_after_us": 100}})
    db.write("metrics", "a", [row(t) for t in (0, 15, 990)], 0)
    report = db.maintain(1000, remote)
    assert (report["checkpointed"], report["evicted_files"], report["shipped_sequence"]) == (1, 2, db.sequence)
    assert times(db) == [0, 15, 990] and db.status()["remote_sequence"] == db.status()["sequence"]
    assert db.vacuum_remote(remote, 0) >= 0 and times(db) == [0, 15, 990]
    assert Database.restore(spark, remote, str(tmp_path / "copy")).scan("metrics").count() == 3
    counters = db.performance()
    assert (counters["batches"], counters["rows"], counters["checkpoints"], counters["archived_files"]) == (1, 3, 1, 2)
    assert "tidemark_sequence " in db.metrics() and "tidemark_healthy 1" in db.metrics()


def test_remote_lock(db, tmp_path):
    remote = str(tmp_path / "remote")
    db.create_table("metrics")
    store = type(db.store)(db.spark, remote)
    assert store.put_new("lock.json", json.dumps({"kind": "ship", "owner": "other", "token": "t"}))
    for operation in (db.ship, db.vacuum_remote):
        with pytest.raises(Rejected, match="locked"):
            operation(remote)
    with pytest.raises(Rejected):
        db.recover_remote_lock(remote, "wrong")
    assert db.recover_remote_lock(remote, "t") and not db.recover_remote_lock(remote, "t")
    assert db.ship(remote) == db.sequence and not store.exists("lock.json")


def test_status_of_a_writer_that_was_overtaken(spark, db):
    other = Database(spark, db.store.root)
    assert db.status()["healthy"] and other.status()["healthy"]
    db.create_table("metrics")
    assert db.status()["healthy"] and not other.status()["healthy"] and db.status()["wal_bytes"] > 0


def test_verified_segments(spark, db, tmp_path):
    db.create_table("metrics", {"shards": 1, "window_us": 10, "rollup_widths_us": [], "policy": {"archive_after_us": 100}})
    db.write("metrics", "a", [row(t) for t in (0, 15, 25, 990)], 0)
    db.checkpoint()
    db.archive(1000, str(tmp_path / "old"))
    assert db.verify("metrics") == []
    t = db.state["tables"]["metrics"]
    t["segments"][0]["rows"] += 1
    assert [p.split(": ")[1] for p in db.verify("metrics")] == ["other rows or times than the manifest says"]
    t["segments"][0]["rows"] -= 1
    db.store.delete(t["segments"][-1]["file"])
    assert [p.split(": ")[1] for p in db.verify("metrics")] == ["missing"]
    odd = next(s for s in t["segments"] if s.get("archive"))
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "odd"))
    assert "columns" in segments.faults(spark, {str(tmp_path / "odd"): odd})[0]


def test_states_are_made_once(db, monkeypatch):
    """A checkpoint leaves the states of one commit as they are; a new width makes its states in one pass, without a second shuffle."""
    db.create_table("metrics", {"rollup_widths_us": [10, 100]})
    db.write("metrics", "a", [row(t, t) for t in range(50)], 0)
    before = db.state["tables"]["metrics"]["deltas"]
    db.checkpoint()
    assert db.state["tables"]["metrics"]["deltas"] == before
    monkeypatch.setattr(ru, "not_finite", lambda states: pytest.fail("the states were made twice"))
    monkeypatch.setattr(type(db.rows("metrics")), "hint", lambda *_: pytest.fail("the states were dealt twice"))
    db.create_continuous_aggregate("fives", "metrics", 5)
    assert [r["count"] for r in db.rollups("metrics", width_us=5).collect()] == [5] * 10
    db.write("metrics", "late", [row(3, 4)], 0)
    db.checkpoint()
    assert len(db.state["tables"]["metrics"]["deltas"]) == 1
    assert {w: db.rollups("metrics", width_us=w).agg(F.sum("count")).first()[0] for w in (5, 10, 100)} == {5: 51, 10: 51, 100: 51}


def test_tasks_sort_a_bounded_number_of_rows(spark, db, monkeypatch):
    """Rows that one task has written are read by many, in more partitions for more widths."""
    monkeypatch.setattr(engine, "TASK_ROWS", 20_000)
    monkeypatch.setattr(segments, "BLOCK", 1 << 18)
    db.create_table("metrics", {"shards": 1, "window_us": 10**6, "rollup_widths_us": [10, 100]})
    i = F.col("id")
    db.write("metrics", "a", spark.range(0, 200_000, 1, 1).select(i.alias("timestamp_us"), F.lit("t").alias("tenant"), F.lit("s").alias("series"), F.rand(1).alias("value"), F.lit(None).cast("map<string,string>").alias("tags")), 0)
    hot = db.state["tables"]["metrics"]["hot"]
    sizes = db._read(hot, 2).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 200_000 and max(sizes) < 100_000 and len(sizes) >= 20
    assert db.rollups("metrics").groupBy("width_us").agg(F.sum("count")).orderBy("width_us").collect() == [(10, 200_000), (100, 200_000)]


def test_small_groups_are_one_file(spark, tmp_path):
    """Segments follow the rows, not how a shuffle is split: a file for each shard and window up to segment_rows, several beyond."""
    i = F.col("id")
    rows = spark.range(0, 30_000, 1, 8).select((i % 3_000).alias("timestamp_us"), F.lit("t").alias("tenant"), i.cast("string").alias("series"), F.rand(1).alias("value"), F.lit(None).cast("map<string,string>").alias("tags"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        for segment_rows, files in ((20_000, 3), (4_000, None)):
            db = Database(spark, str(tmp_path / str(segment_rows)), segment_rows=segment_rows)
            db.create_table("metrics", {"shards": 1, "window_us": 1_000, "rollup_widths_us": []})
            db.write("metrics", "a", rows, 0)
            db.checkpoint()
            found = db.segments("metrics")
            assert sum(s["rows"] for s in found) == 30_000 and max(s["rows"] for s in found) <= segment_rows
            assert len(found) == files if files else len(found) >= 9
            assert db.rows("metrics").select("series").distinct().count() == 30_000 and not db.verify("metrics")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
