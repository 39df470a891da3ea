"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each the majority over the text's shingles of that bit of the
shingle's XXH64.  Two fingerprints that differ in at most two bits share a string at
one bit or less from either, so each distinct fingerprint emits itself and its 64
neighbours; rows meet by variant.  All that meet at a variant are within two bits of each other, and
there are 65 at most, so a chain through them, verified and without repeats, ties the same
components as all pairs would.

Equal texts, and other texts of one fingerprint, are one class from the start: the rows
that are shuffled by variant don't grow with copies.

Defined results: a null text is an empty one; a text without words has fingerprint zero and
links like any other; fewer words than a shingle give one shingle of them all.  Null ids stay in the
result but never name a component (a component without ids has a null name); repeated
rows are in one component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.durable import cut, gathered, gathered_input
from tidemark.llm.frames import batch_of, id_text, map_batches, utf8_slices

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
BLOCK = 1 << 14  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included, of the text with A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: -width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        raw = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8_slices(batch.column("text"))
        fps = np.array([fingerprint(shingle_hashes(raw[at[i] : at[i + 1]].tobytes(), width)) for i in range(batch.num_rows)], np.uint64)
        return batch_of(doc_id=batch.column("doc_id"), fp=fps.view(np.int64))

    return map_batches(id_text(df, id_col, text_col), run, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: links of distinct fingerprints (fp) that tie the components of the graph of all pairs within RADIUS."""
    ball = distinct.select("fp", F.explode(F.expr(f"transform(sequence(0, {BITS}), i -> if(i = {BITS}, fp, fp ^ shiftleft(1L, i)))")).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = ball.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_components(fps: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of fps (doc_id, fp), which is read several times."""
    rows = fps.count()
    classes = cut(gathered(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), rows))
    # of the variants of a fingerprint, all but the least of those that meet give a link at most
    tied = components(links(classes.select("fp")), (BITS + 1) * classes.count())
    rooted = classes.join(tied, classes["fp"] == tied["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return gathered(fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id"), rows)


def simhash_components(df: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return near_components(cut(fingerprints(gathered_input(df), width, id_col, text_col)))
