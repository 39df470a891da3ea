"""Connected components of a graph of links, by large-star and small-star rounds.

Each round is joins and aggregates keyed by node, so no component meets in one task, and
its edges go through the checkpoint folder.  Chains halve in each pair of
steps, so the number of rounds grows with the logarithm of the longest one.

A round's tasks follow its edges, ``TASK_EDGES`` to each, and are as many as the cores at least: rows of two numbers in as many tasks and files
as shuffles have partitions would cost more disk for the files than for the rows.  The least neighbours are broadcast while they are few enough, so
the neighbours of one node meet in no task; beyond that the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import cut, gathered, tasks_for
from tidemark.llm.frames import BROADCAST_ROWS

#: Edges to a task of a round.
TASK_EDGES = 100_000
#: Of edges that are only known to be so many at most: a task may get as many.
MOST_TASK_EDGES = 1_000_000


def _stars(edges: DataFrame, n: int, *, large: bool) -> DataFrame:
    """Large: each larger neighbour of u is tied to the least of u and its neighbours.  Small: each smaller one, and u.

    n: edges at most.
    """
    few = _tasks(edges, n)
    if large:
        pairs = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # nodes: two for an edge at most, one if only its larger end counts
    least = F.broadcast(least.coalesce(few)) if n * (2 if large else 1) <= BROADCAST_ROWS else least.hint("shuffle_merge")
    tied = pairs.join(least, F.col("a") == F.col("u"))
    if large:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # u's own row comes from each of its edges: it has one at least
        both = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        out = tied.select(F.explode(both).alias("p")).select("p.a", "p.b")
    return out.where("a <> b").distinct().coalesce(few)


def _tasks(edges: DataFrame, n: int) -> int:
    return tasks_for(edges, n, TASK_EDGES)


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of edges (a, b: long; either order, repeats and loops allowed).

    most: edges at most, if the caller knows; the first frame of them takes as many tasks as these need.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(edges if most is None else gathered(edges, most, MOST_TASK_EDGES))
    mark = _mark(edges)
    while mark[0]:
        few = edges.coalesce(_tasks(edges, mark[0]))
        # a large star makes an edge at most of each that it reads, so this round's edges bound both
        edges = cut(_stars(_stars(few, mark[0], large=True), mark[0], large=False))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(_tasks(edges, mark[0]))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
