"""Packing documents into sequences of at most ``LIMIT`` tokens, as few as can be.

A document longer than the limit is cut into full pieces and a rest.  Pieces over a third of
the limit are large: a sequence holds two at most, which are matched greedily, the
longest first with the longest that still fits.  Smaller pieces, the longest first,
go where they leave the least room (best fit), and open a sequence only where none has room.

Only how many pieces there are of each length matters for that, so the plan is made
on the driver from a histogram with at most ``limit`` entries, whatever the number of
documents, with runs of alike sequences handled at once: a plan row says that pieces of
one length with ranks [first, first + n) go, ``per`` to a sequence, to consecutive sequences from
``bin`` on at ``offset``.  A plan has at most a few rows for each pair of length and room
(``max_plan_rows``), a bound without the number of documents in it.
Ranks are dealt without a global order or a group in one task: within (length, shard), plus the
counts of the shards before.

Defined results: a null text is an empty one, whose only token is the end id; rows are
independent documents, so repeated rows are packed as often as they occur, and ids may be null; an empty table gives no
rows; other columns are ignored.  Sequence numbers are any distinct numbers.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import BROADCAST_ROWS, batch_of, groups_of, id_text, mapped, utf8_slices
from tidemark.llm.tokens import word_ids

LIMIT = 4096
END_ID = 1
#: Texts whose words are looked up together.
GROUP_BYTES = 4 << 20
#: Pieces for which one more shard of ranks is opened.
SHARD_ROWS = 5_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, first long, n long, per long, bin long, offset long"


def pieces(df: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_ids(tokenizer_path)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            _, at = utf8_slices(texts)
            owner, piece, length, crc, parts = [], [], [], [], []
            for first, last in groups_of(np.diff(at), GROUP_BYTES):
                for i, data in enumerate(vocabulary.text_ids(texts.slice(first, last - first)), first):
                    data += end
                    for k, a in enumerate(range(0, len(data), 4 * limit)):
                        part = data[a : a + 4 * limit]
                        owner.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            which = np.asarray(piece, np.int64)
            out = {
                "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int32())),
                "piece": pa.array(which, pa.int32()),
                "start": which * limit,
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.array(parts, pa.list_(pa.int32()))
            if owner:
                yield batch_of(**out)

    return mapped(id_text(df, id_col, text_col), run, PIECES + (", ids array<int>" if with_ids else ""), keeps="tokens")


class Rooms:
    """Runs of alike sequences by the room left: room -> [(first sequence, how many)]."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, n: int) -> None:
        if n <= 0 or room <= 0:
            return
        if room not in self.runs:
            bisect.insort(self.rooms, room)
            self.runs[room] = []
        self.runs[room].append((first, n))

    def take(self, at_least: int) -> tuple[int, int, int] | None:
        """(room, first, n) of a run with the least room that is enough."""
        i = bisect.bisect_left(self.rooms, at_least)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[i]
        return room, first, n


def max_plan_rows(limit: int) -> int:
    """A bound on plan rows: each length meets each run of sequences once, and a length leaves at most three more runs."""
    return 4 * limit * limit


def plan(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan rows (length, first, n, per, bin, offset) for so many pieces of each length, and the number of sequences."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = {size: n for size, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rooms, bins = Rooms(), 0

    def put(size: int, n: int, per: int, at: int, offset: int) -> None:
        rows.append((size, used[size], n, per, at, offset))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > limit)
    live = list(large)
    while live:
        size = live[-1]
        i = bisect.bisect_right(live, limit - size) - 1
        if i < 0:
            n = left[size]
            put(size, n, 1, bins, 0)
            rooms.put(limit - size, bins, n)
            bins += n
            live.pop()
            continue
        mate = live[i]
        if mate == size:
            n = left[size] // 2
            if n:
                put(size, 2 * n, 2, bins, 0)
                rooms.put(limit - 2 * size, bins, n)
                bins += n
            if left[size]:  # one is over: it takes the next shorter one, if there is one
                del live[-1]
                if live:
                    mate = live[-1]
                    put(size, 1, 1, bins, 0)
                    put(mate, 1, 1, bins, size)
                    rooms.put(limit - size - mate, bins, 1)
                else:
                    put(size, 1, 1, bins, 0)
                    rooms.put(limit - size, bins, 1)
                bins += 1
        else:
            n = min(left[size], left[mate])
            put(size, n, 1, bins, 0)
            put(mate, n, 1, bins, size)
            rooms.put(limit - size - mate, bins, n)
            bins += n
        live = [s for s in live if left[s] > 0]
    for size in sorted((s for s in left if 3 * s <= limit), reverse=True):
        while left[size]:
            got = rooms.take(size)
            if got is None:  # all rooms are too small: sequences of only this length
                per = limit // size
                n = -(-left[size] // per)
                got = (limit, bins, n)
                bins += n
            room, first, n = got
            per = room // size
            full = min(n, left[size] // per)
            if full:
                put(size, full * per, per, first, limit - room)
                rooms.put(room - per * size, first, full)
            if full < n and left[size]:
                rest = left[size]  # fewer than per
                put(size, rest, rest, first + full, limit - room)
                rooms.put(room - rest * size, first + full, 1)
                full += 1
            rooms.put(room, first + full, n - full)
    return rows, bins


def pack(spark: SparkSession, cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The pieces with sequence_id and offset.  cut_pieces is read three times: give it cut from its lineage."""
    shards = max(1, -(-cut_pieces.count() // SHARD_ROWS))
    dealt = cut_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    counted = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    by_length = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # limit rows at most
    rows, _ = plan(by_length, limit)
    # each length's ranges follow one another, so a sorted list of first ranks finds a rank's range
    steps = spark.createDataFrame(rows, PLAN).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "n", "per", "bin", "offset"))).alias("ranges"))
    own = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("local", F.row_number().over(own) - 1).join(base, ["length", "shard"]).withColumn("rank", F.col("local") + F.col("base"))
    # thousands of rows at this limit, whatever the table; a plan that is longer is shuffled
    placed = ranked.join(F.broadcast(steps) if len(rows) <= BROADCAST_ROWS else steps, "length")
    return placed.select(*cut_pieces.columns, *_place("ranges", "rank", "length"))


def _place(ranges: str, rank: str, length: str) -> list:
    r = F.filter(ranges, lambda x: (x["first"] <= F.col(rank)) & (F.col(rank) < x["first"] + x["n"]))[0]
    at = F.col(rank) - r["first"]
    return [(r["bin"] + F.floor(at / r["per"])).cast("long").alias("sequence_id"), (r["offset"] + (at % r["per"]) * F.col(length)).cast("long").alias("offset")]
