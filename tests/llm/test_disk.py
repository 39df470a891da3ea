"""What the shared steps leave on disk, and how many tasks they take."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, durable, simhash


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("how", [durable.cut, durable.stored])
def test_frames_leave_no_shuffle_files(spark, how):
    """Once written, a frame's shuffles go, though the driver collects no garbage; the session's setting stays."""
    df = spark.range(3000).groupBy((F.col("id") % 100).alias("k")).count().repartition(5, "count")
    setting, before = spark.conf.get(durable.CLEANUP, "false"), shuffle_files(spark)
    kept = how(df)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(durable.CLEANUP, "false") == setting
    assert sorted(kept.collect()) == sorted(df.collect())


def test_a_small_graph_takes_few_tasks(spark):
    """The frame's tasks follow the number of edges and of cores, not that of shuffle partitions or of the input's."""
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(50)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = components.components(edges)
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_frames_are_few_files(spark, monkeypatch):
    """Fingerprints of an input in many small files and shuffles of many partitions: what is kept and what is returned take few tasks."""
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    words = "one two three four five six seven eight nine ten".split()
    docs = durable.stored(spark.createDataFrame([(i, " ".join(words[i % 7 :]) + f" {i % 20}") for i in range(300)], "doc_id long, text string").repartition(40))
    kept = []
    for module in (components, simhash):
        monkeypatch.setattr(module, "cut", lambda df: kept.append(durable.cut(df)) or kept[-1])
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # two files to a task
        assert docs.rdd.getNumPartitions() >= 20
        found = simhash.simhash_components(docs)
        assert found.count() == 300
        assert all(df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism for df in [*kept, found])
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("broadcast", "task"), [(0, 100_000), (1_000_000, 7), (150, 50)])
def test_components_by_either_join(spark, monkeypatch, broadcast, task):
    """Broadcast or shuffled, in one task or many: the same roots, on hubs, chains and a random forest."""
    monkeypatch.setattr(components, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(components, "TASK_EDGES", task)
    rnd = random.Random(8)
    edges = [(1000, k) for k in range(1001, 1100)] + [(i, i + 1) for i in range(40)] + [(a, rnd.choice([a - 1, a - 2, a - 3, 5000])) for a in range(5003, 5090)]
    rnd.shuffle(edges)
    expected = {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1100)}
    root = {n: n for e in edges if e[0] >= 5000 for n in e}
    for _ in range(100):
        for a, b in edges:
            if a >= 5000:
                root[a] = root[b] = min(root[a], root[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == expected | root
    assert len(got) == len(expected | root)
