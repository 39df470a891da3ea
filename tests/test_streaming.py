from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.engine import Database
from tidemark.model import Rejected
from tidemark.operators import rollup as ru
from tidemark.operators.joins import asof_join, band_join
from tidemark.sources.adapters import event_rows
from tidemark.sources.output import json_rows
from tidemark.streaming.ingest import into_table, json_stream, rollup_deltas
from tidemark.streaming.ingestor import Ingestor


def test_files_into_a_table_once(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("metrics", {"rollup_widths_us": [10]})
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        rows = [{"timestamp_us": 10 * i + k, "tenant": "t", "series": "s", "value": 1.0, "tags": {}} for k in range(4)]
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        into_table(json_stream(spark, str(folder)), db, "metrics", str(tmp_path / "cp"), name="files", clock_us=lambda: 0, once=True).awaitTermination()
    assert db.rows("metrics").count() == 12 and sorted(r["count"] for r in db.rollups("metrics").collect()) == [4, 4, 4]
    into_table(json_stream(spark, str(folder)), db, "metrics", str(tmp_path / "cp2"), name="files", clock_us=lambda: 0, once=True)
    assert db.rows("metrics").count() == 12


def test_stream_of_deltas_equals_one_batch(spark, sf_dir, tmp_path):
    rows = event_rows(spark, sf_dir)
    source, sink = str(tmp_path / "rows"), str(tmp_path / "deltas")
    rows.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    rollup_deltas(stream, [3_600_000_000], lambda df: df.write.mode("append").parquet(sink), str(tmp_path / "cp"), once=True).awaitTermination()
    merged = ru.merge(spark.read.parquet(sink)).drop("sum")
    assert sorted(merged.collect()) == sorted(ru.rollup(rows, [3_600_000_000]).drop("sum").collect())


def test_queue_commits_groups(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("metrics", {"rollup_widths_us": []})
    queue = Ingestor(db, lambda: 0, slots=3, group=2)
    rows = [{"timestamp_us": 1, "tenant": "t", "series": "s", "value": 1.0, "tags": {}}]
    futures = [queue.submit("metrics", "a", rows), queue.submit("none", "b", rows), queue.submit("metrics", "a", rows)]
    with pytest.raises(Rejected):
        queue.submit("metrics", "c", rows)
    assert queue.flush() == 3 and futures[0].result()["sequence"] == 2 and futures[2].result()["duplicate"]
    assert isinstance(futures[1].exception(), Rejected)
    assert (queue.stats.accepted, queue.stats.refused, queue.stats.groups) == (2, 1, 2)
    queue.shutdown()
    with pytest.raises(Rejected):
        queue.submit("metrics", "d", rows)


def test_json_results(spark):
    df = spark.sql("SELECT CAST(1 AS DECIMAL(20,0)) AS d, named_struct('x', CAST(2 AS DECIMAL(20,0))) AS n, DATE'2024-01-02' AS day, CAST(NULL AS STRING) AS gone, 1.5D AS f")
    assert json_rows(df) == [{"d": "1", "n": {"x": 2}, "day": "2024-01-02", "gone": None, "f": 1.5}]
    for bad in (spark.sql("SELECT CAST('NaN' AS DOUBLE) AS f"), spark.range(5)):
        with pytest.raises(Rejected):
            json_rows(bad, 3)


def test_commands(spark, tmp_path):
    root = ["--root", str(tmp_path / "db"), "--now-us", "0"]
    document = tmp_path / "w.json"
    document.write_text(json.dumps({"table": "metrics", "request_id": "r", "rows": [{"timestamp_us": t, "tenant": "demo", "series": "cpu", "value": v, "tags": {"host": "one"}} for t, v in ((1_000_000, 12.5), (2_000_000, 17.5))]}))
    cli.run(spark, [*root, "init"])
    cli.run(spark, [*root, "create", "metrics"])
    assert cli.run(spark, [*root, "write", str(document)])["rows"] == 2
    assert cli.run(spark, [*root, "query", "SELECT count(*) AS count, sum(value) AS total FROM metrics"]) == [{"count": 2, "total": 30.0}]
    assert len(cli.run(spark, [*root, "scan", "metrics", "--start", "1500000"])) == 1
    assert cli.run(spark, [*root, "rollups", "metrics", "--width", "60000000"])[0]["count"] == 2
    assert cli.run(spark, [*root, "ship", "--remote", str(tmp_path / "r")])["sequence"] == 2
    assert cli.run(spark, ["--root", str(tmp_path / "copy"), "restore", "--remote", str(tmp_path / "r")])["tables"] == 1


def test_queue_flushes_by_itself(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.create_table("t", {"rollup_widths_us": []})
    queue = Ingestor(db, lambda: 0, linger_s=0.05)
    queue.start()
    futures = [queue.submit("t", f"r{i}", [{"timestamp_us": i, "tenant": "a", "series": "b", "value": 1.0}]) for i in range(5)]
    assert all(f.result(timeout=60)["rows"] == 1 for f in futures)
    queue.shutdown()
    assert db.rows("t").count() == 5 and queue.stats.groups < 5
    with pytest.raises(Rejected):
        queue.submit("t", "late", [])


def test_queue_is_bounded_by_bytes(spark, tmp_path):
    queue = Ingestor(Database(spark, str(tmp_path / "db")), lambda: 0, queue_bytes=100)
    queue.submit("t", "a", [{"tenant": "x" * 200}])  # one request is taken whatever its size
    with pytest.raises(Rejected, match="full"):
        queue.submit("t", "b", [{"tenant": "x"}])


def test_joins_whatever_the_columns_are_called(spark):
    left = spark.createDataFrame([(1, 10, "l"), (1, 30, "m"), (None, 10, "n"), (2, None, "o")], "k int, _at int, own_0 string")
    right = spark.createDataFrame([(1, 5, "a"), (1, 30, "b"), (1, None, "c"), (None, 1, "d")], "k int, _side int, _right string")
    got = asof_join(left, right, ["k"], "_at", "_side", ["_right"]).collect()
    assert sorted((r.own_0, r._right) for r in got) == [("l", "a"), ("m", "b"), ("n", None), ("o", None)]
    met = band_join(left, right.withColumnRenamed("_right", "_bucket"), ["k"], F.col("_at"), F.col("_side"), 5).collect()
    assert sorted((r.own_0, r._bucket) for r in met) == [("l", "a"), ("m", "b")]
    with pytest.raises(Rejected):
        asof_join(left, right.withColumnRenamed("_right", "own_0"), ["k"], "_at", "_side", ["own_0"])
