"""Near-duplicate texts: Jaccard similarity of their sets of five-word shingles, SimHash balls first, MinHash bands for the rest.

1. Texts whose 64-bit SimHashes (of five-word shingles) are within two bits meet by ball hashing, as in ``simhash``.
2. At the threshold about ten of 64 bits differ, beyond any radius whose balls could be emitted.  So texts that share a band of ``BAND``
   MinHashes of their shingles are candidates too: first each text with that least member of its bands with which it shares most.
3. What holds is tied; then all texts of a band that still holds several groups are compared in tiles; pairs are never rows.

Every link is verified on the shingle sets; hashes neither accept nor reject a pair that has met.  A pair at the threshold meets in no band with a
probability of a millionth, however the texts differ.  Texts are told apart by 128 bits.

Defined results: a null text is an empty one; texts of fewer than five words have one shingle, the whole; texts
without words are alike; of each group the row with the least id stays (null ids last; of repeated rows one); an empty table gives
no rows; very long texts are handled whole; all columns of the input, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.durable import cut
from tidemark.llm.embeddings import forest
from tidemark.llm.frames import batch_of, free_names, id_text, map_batches, mapped, small_side, utf8_slices
from tidemark.llm.simhash import fingerprint, links
from tidemark.llm.windows import NO_ID, in_groups, mix, starts_of

WORDS = 5
SIMILARITY = 0.8
#: MinHashes to a band, and bands: a pair at the threshold shares none with a probability of a millionth, however the texts differ.
BAND = 6
BANDS = math.ceil(math.log(1e-6) / math.log(1 - SIMILARITY**BAND))
#: Rows and shingles of a tile in which texts of one band are compared.
TILE = 512
TILE_ITEMS = 1 << 19


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of the text with A-Z in lower case."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text.lower().split()], np.uint64)


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of width words, repeats included; of fewer words one, of none none."""
    if not len(hashes):
        return hashes
    n = max(len(hashes) - width + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(hashes))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the runs of width words of the text with A-Z in lower case, sorted."""
    return np.unique(runs(word_hashes(text), width))


def band_keys(items: np.ndarray) -> np.ndarray:
    """A hash for each band: of its number and its MinHashes of the items."""
    numbers = np.arange(BANDS * BAND, dtype=np.uint64)
    factors = mix((numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(items), 256):
        least = np.minimum(least, (items[at : at + 256, None] * factors).min(axis=0))
    out = mix(numbers[:BANDS] + np.uint64(1))
    for k in range(BAND):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least[k * BANDS : (k + 1) * BANDS])
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """h1, h2, size, fp, bands of the texts of rows (h1, h2, text), equal texts of a batch once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8_slices(batch.column("text"))
        names = np.stack([batch.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        _, which = np.unique(names, axis=0, return_index=True)
        sizes, fps, bands = [], [], []
        for i in which.tolist():
            found = runs(word_hashes(raw[at[i] : at[i + 1]].tobytes()), WORDS)
            fps.append(fingerprint(found))
            found = np.unique(found)
            sizes.append(len(found))
            bands.append(band_keys(found).view(np.int64))
        return batch_of(
            h1=names[which, 0], h2=names[which, 1], size=pa.array(sizes, pa.int64()), fp=np.array(fps, np.uint64).view(np.int64), bands=pa.array(bands, pa.list_(pa.int64()))
        )

    return map_batches(rows, run, "h1 long, h2 long, size long, fp long, bands array<long>")


def ball_pairs(sigs: DataFrame) -> DataFrame:
    """a, b: texts (u) of one fingerprint, or of fingerprints that the balls tie."""
    heads = sigs.groupBy("fp").agg(F.min("u").alias("head"), F.count("*").alias("n"))
    same = sigs.join(heads.where("n > 1"), "fp").where("u <> head").select(F.col("head").alias("a"), F.col("u").alias("b"))
    met = links(heads.select("fp"))
    one, two = (heads.select(F.col("fp").alias(x), F.col("head").alias(f"u{x}")) for x in ("a", "b"))
    return same.unionAll(met.join(one, "a").join(two, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b")))


def shared_bands(sigs: DataFrame) -> DataFrame:
    """key, u, size, head: the texts of each band that several share, and the least of them."""
    rows = sigs.select("u", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("u").alias("head"), F.max("u").alias("top")).where("head <> top").select("key", "head")
    return rows.join(shared, "key").join(sigs.select("u", "size"), "u")


def best_pairs(members: DataFrame) -> DataFrame:
    """a, b: each text and that head of its bands with which it shares most."""
    shared = members.where("u <> head").groupBy("u", "head").agg(F.count("*").alias("n"))
    return shared.groupBy("u").agg(F.max(F.struct("n", "head")).alias("best")).select(F.col("best.head").alias("a"), F.col("u").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose shingle sets (u, items sorted) have the similarity."""
    left = pairs.join(sets.select(F.col("u").alias("a"), F.col("items").alias("one")), "a")
    both = left.join(sets.select(F.col("u").alias("b"), F.col("items").alias("two")), "b").select("a", "b", "one", "two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("one", "two"))
                common = len(np.intersect1d(one, two, assume_unique=True))
                total = len(one) + len(two) - common
                keep.append(not total or common >= SIMILARITY * total)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return mapped(both, run, "a long, b long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """u, items of the texts of rows (u, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = utf8_slices(batch.column("text"))
        items = [shingle_set(raw[at[i] : at[i + 1]].tobytes(), WORDS).tobytes() for i in range(batch.num_rows)]
        return batch_of(u=batch.column("u"), items=pa.array(items, pa.binary()))

    return map_batches(rows, run, "u long, items binary")


def open_tiles(members: DataFrame, tied: DataFrame) -> DataFrame:
    """u, root, block, tile, one, two: the rows of bands that hold several roots, in each pair of tiles that they belong to.

    Of bands with the same texts one is enough.
    """
    named = members.join(tied.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("root", F.coalesce("root", "u"))
    marks = [F.expr("bit_xor(xxhash64(u))").alias("x"), F.sum(F.xxhash64(F.lit(7), "u").cast("decimal(38,0)")).alias("s")]
    several = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("size"), *marks).where("low <> high")
    one = several.groupBy("n", "size", "x", "s").agg(F.min("key").alias("key"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") / TILE_ITEMS)).cast("int")
    rows = named.join(one.select("key", tiles.alias("tiles")), "key")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64(F.lit(3), "u"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("one", F.least("tile", "other")).withColumn("two", F.greatest("tile", "other"))
    return rows.select("u", "root", F.xxhash64("key", "one", "two").alias("block"), "tile", "one", "two")


def alike(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows left and right of items (sets): which have the similarity."""
    sizes = np.array([len(x) for x in items])
    names, flat, seen = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(items)), sizes)
    some = seen[flat] > 1
    order = np.argsort(flat[some], kind="stable")
    owner, column = owner[some][order], (np.cumsum(seen > 1) - 1)[flat[some][order]]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((seen > 1).sum()), 1024):
        a, b = np.searchsorted(column, [at, at + 1024])
        held = np.zeros((len(items), 1024), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        common += held[left] @ held[right].T
    total = sizes[left][:, None] + sizes[right][None] - common.astype(np.float64)
    return common >= SIMILARITY * total


def tile_links(rows: DataFrame) -> DataFrame:
    """a, b: links that tie what each block of rows (open_tiles with items, sorted by block) ties beyond its roots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, "block", 512):
            columns = {c: batch.column(c).to_numpy() for c in ("u", "root", "block", "tile", "one", "two")}
            heads = np.flatnonzero(starts_of(columns["block"]))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for at, stop in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                root, tile = columns["root"][at:stop], columns["tile"][at:stop]
                if (root == root[0]).all():
                    continue
                left, right = np.flatnonzero(tile == columns["one"][at]), np.flatnonzero(tile == columns["two"][at])
                if not len(left) or not len(right):
                    continue
                items = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("items").slice(at, stop - at)]
                i, j = np.nonzero(alike(items, left, right) & (root[left][:, None] != root[right][None]))
                u = columns["u"][at:stop]
                tied = forest(len(u), left[i], right[j])
                some = np.flatnonzero(tied != np.arange(len(u)))
                out.append((u[some], u[tied[some]]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield batch_of(a=a, b=b)

    return mapped(rows, run, "a long, b long")


def text_hashes(text: str | Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def groups(docs: DataFrame) -> DataFrame:
    """h1, h2, root: the group of each distinct text of rows (h1, h2, k, text) that isn't alone; k tells rows of a text apart."""
    found = signatures(docs.select("h1", "h2", "text")).groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("size", "fp", "bands")])
    sigs = cut(found.withColumn("u", F.monotonically_increasing_id()))
    members = cut(shared_bands(sigs))
    pairs = ball_pairs(sigs.select("u", "fp")).unionAll(best_pairs(members))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("u")).unionAll(pairs.select(F.col("b").alias("u"))).unionAll(members.select("u")).distinct()
    named = sigs.select("u", "h1", "h2").join(wanted, "u")
    # the row with the least key speaks for its text: keyed by all three, copies of one text don't meet in one task
    least = docs.groupBy("h1", "h2").agg(F.min("k").alias("k"))
    speakers = cut(least.join(named, ["h1", "h2"]).select("u", "h1", "h2", "k"))
    texts = docs.join(small_side(speakers), ["h1", "h2", "k"]).select("u", "text")
    sets = cut(shingle_sets(texts).groupBy("u").agg(F.first("items").alias("items")))
    tied = cut(components(similar(pairs, sets), pairs.count()))
    tiles = open_tiles(members, tied).join(sets, "u").repartition("block").sortWithinPartitions("block")
    stars = tied.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    whole = components(stars.unionAll(tile_links(tiles)))
    return sigs.select("u", "h1", "h2").join(whole.select(F.col("node").alias("u"), "root"), "u").select("h1", "h2", "root")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    h1, h2 = text_hashes("text")
    keyed = id_text(docs, id_col, text_col).select(h1.alias("h1"), h2.alias("h2"), F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), "text")
    # by text and key first: copies of one text under many keys don't meet in one task
    counts = keyed.groupBy("h1", "h2", "k").agg(F.count("*").alias("times"))
    texts = counts.groupBy("h1", "h2").agg(F.min(F.struct("k", "times")).alias("least"), F.sum("times").alias("n")).select("h1", "h2", "least.*", "n")
    named = texts.join(groups(keyed), ["h1", "h2"], "left")
    first = named.where("root is not null").groupBy("root").agg(F.min(F.struct("k", "h1", "h2")).alias("stays"))
    marked = named.join(first, "root", "left")
    stays = F.col("root").isNull() | (F.struct("k", "h1", "h2") == F.col("stays"))
    # what has to be known of rows: of texts that go, and of texts with several rows
    special = cut(marked.select("h1", "h2", "k", "times", "n", stays.alias("stays")).where("not stays or n > 1").drop("n"))
    repeats = special.where("stays and times > 1").limit(1).count() > 0
    own = dict(zip(("h1", "h2", "k", "s1", "s2", "sk", "stays", "times"), free_names(docs, 8), strict=True))
    text, name = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    rows = docs.withColumns(dict(zip((own["h1"], own["h2"], own["k"]), (*text_hashes(text), F.coalesce(name, F.lit(NO_ID))), strict=True)))
    sides = special.select(*[F.col(a).alias(own[b]) for a, b in (("h1", "s1"), ("h2", "s2"), ("k", "sk"), ("stays", "stays"), ("times", "times"))])
    met = rows.join(small_side(sides), (F.col(own["h1"]) == F.col(own["s1"])) & (F.col(own["h2"]) == F.col(own["s2"])), "left")
    met = met.where(F.col(own["stays"]).isNull() | (F.col(own["stays"]) & (F.col(own["k"]) == F.col(own["sk"]))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not repeats:
        return met.select(*columns)
    several = F.coalesce(F.col(own["times"]) > 1, F.lit(False))
    return met.where(~several).select(*columns).unionAll(met.where(several).dropDuplicates([own["h1"], own["h2"]]).select(*columns))
