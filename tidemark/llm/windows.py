"""Repeated windows of a fixed number of tokens in any texts: the shared part of both exact substring operators.

Every window picks an anchor: the k-gram in it with the least hash, the leftmost of equals.  Equal
windows pick the same anchor at the same offset, neighbouring windows mostly share theirs, so a text is
cut into runs of windows by anchor, and only one row for each run is shuffled, by anchor.

1. ``anchors``: rows of the runs of each distinct text.  A batch keeps two rows for equal runs.
2. ``resolve``: rows meet by anchor.  What stays open is a run of which a neighbouring part, left or right of the anchor, also occurs
   elsewhere, and of runs whose whole content seems equal two; the others of these follow them.
3. The content of open runs meets by anchor again, and the operator's kernel compares its windows exactly: it decides.

Equal texts are one text from the start.  Anchors that many texts hold aren't shuffled as one key: their runs are split into windows, and these
meet by their own hashes, once for each batch, and are settled by them.  They are found on a sample, which only steers work and never results: of ``SAMPLE_TEXTS``
rows, and of one in ``ROWS_PER_SAMPLED`` where that is more, so that the rows of an anchor that is not split have a bound at any size of the table.

Texts are sorted before their runs are made, so that a task that runs again after a lost executor gives the same rows.
Runs are told apart by 64 bits of anchor and 64 of content before the kernel sees them, texts by 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import batch_of, mapped, utf8_slices

SAMPLE_TEXTS = 20_000
ROWS_PER_SAMPLED = 10_000
HOT_TEXTS = 10
NO_ID = (1 << 63) - 1  # a null id comes after all others
BLOCK = 1 << 20  # windows of a text handled at once
MOST_WINDOWS = 8000  # of a run; 13 bits hold them
MERGED_ROWS = 400_000  # rows of runs among which a task looks for equal ones
EQUALS = 8190  # stands for one window and all its equals in the text
COLD, WINDOW, DONE, COLD_AGAIN, WINDOW_AGAIN = range(5)
ROWS = "key long, rh long, x long, m long, al long"
FOUND = "m long, t long, key long, al long"
CONTENT = "key long, m long, t long, a long, l int, at int, content binary"
RANGES = "m long, t long, a long, l long"

_MULTIPLIER = 0x9E3779B97F4A7C15  # 5 modulo 8
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers over all bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of all runs of tokens of a text: a polynomial modulo 2**64, from prefix sums."""

    up = np.empty(0, _U)
    down = np.empty(0, _U)

    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens) + 1
        if len(Grams.up) < n:
            size = max(1 << 16, 1 << n.bit_length())
            Grams.up, Grams.down = _powers(_MULTIPLIER, size), _powers(pow(_MULTIPLIER, -1, 2**64), size)
        self.sums = np.zeros(n, _U)
        np.cumsum(tokens * self.up[: n - 1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def at(self, first: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[first + size] - self.sums[first]) * self.down[first])


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each width neighbours: of a block's end part and the next block's beginning."""
    n = len(keys)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(_U).max, _U)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Shape:
    """window: tokens of a window; gram: of an anchor; side: of the part beside it that must recur; tokens: bytes -> 64-bit tokens."""

    window: int
    gram: int
    side: int
    tokens: Callable[[bytes], np.ndarray]
    #: "again": a window that starts anywhere else goes; "earlier": one that starts in a text with a smaller id.
    rule: str
    #: Tokens are the text's bytes: its content is hashed and compared as it is.
    by_byte: bool = False

    @property
    def again(self) -> bool:
        return self.rule == "again"


def runs_of(tokens: np.ndarray, shape: Shape) -> Iterator[tuple[int, Grams, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of the text: its first token, its grams, and anchor hash, anchor place, first window and windows of each run."""
    n = len(tokens) - shape.window + 1
    spread = shape.window - shape.gram + 1
    low = _U((1 << 24) - 1)
    for base in range(0, max(n, 0), BLOCK):
        part = tokens[base : base + BLOCK + shape.window - 1]
        grams = Grams(part)
        hashes = grams.all(shape.gram)
        least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=_U), spread) & low
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        place = least[first].astype(np.int64)
        yield base, grams, hashes[place], place, first, np.diff(np.append(first, len(least)))


def side_hashes(grams: Grams, place: np.ndarray, shape: Shape) -> np.ndarray:
    """16 bits for the tokens left and right of each anchor, 0 where the block has too few."""
    n = len(grams.sums) - 1
    out = np.zeros(len(place), np.int64)
    for first, shift in ((place - shape.side, 16), (place + shape.gram, 0)):
        ok = (first >= 0) & (first + shape.side <= n)
        bits = (grams.at(first[ok], shape.side) >> _U(48)).astype(np.int64)
        out[ok] |= np.maximum(bits, 1) << shift
    return out


def packed(a: np.ndarray, count: np.ndarray | int, kind: np.ndarray | int, tie: int = 0) -> np.ndarray:
    """a: 31 bits, 13 of the number of windows, 3 of kind, 16 of the text's hash."""
    return ((a << 13 | count) << 3 | kind) << 16 | tie


def text_keys(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The high 32 and the low 16 of the 48 bits that tell texts with equal ids apart."""
    return t >> 16, t & 0xFFFF


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, _U).view(np.int64)


def anchors(texts: DataFrame, shape: Shape, hot: np.ndarray) -> DataFrame:
    """ROWS for the runs of texts (m, t, n, text).  x: side hashes and high bits of t; al: see ``packed``."""

    def of_text(text: bytes, again: bool) -> list[np.ndarray]:
        tokens = shape.tokens(text)
        raw, wide = (memoryview(text), 1) if shape.by_byte else (memoryview(np.ascontiguousarray(tokens)).cast("B"), 8)
        digest = xxhash.xxh3_64_intdigest
        out = []
        for base, grams, hashes, place, first, count in runs_of(tokens, shape):
            slot = np.minimum(np.searchsorted(hot, hashes), max(len(hot) - 1, 0))
            split = hot[slot] == hashes if len(hot) else np.zeros(len(hashes), bool)
            keep = ~split
            a, c = first[keep] + base, count[keep]
            ends = (a + c + shape.window - 1) * wide
            rh = np.array([digest(raw[i:j]) for i, j in zip((a * wide).tolist(), ends.tolist(), strict=True)], _U)
            key = hashes[keep] & ~_U(1)
            head, c, several = one_for_equal_neighbours(key, rh, a, c)
            kind = np.where(several & shape.again | again, COLD_AGAIN, COLD)
            out.append(np.stack([signed(key[head]), signed(rh[head]), side_hashes(grams, place[keep][head], shape), packed(a[head], c, kind)]))
            if split.any():
                s = np.concatenate([np.arange(f, f + k) for f, k in zip(first[split].tolist(), count[split].tolist(), strict=True)])
                key = np.array([digest(raw[i : i + shape.window * wide]) for i in ((s + base) * wide).tolist()], _U) | _U(1)
                _, head, times = np.unique(key, return_index=True, return_counts=True)
                kind = np.where((times > 1) & shape.again | again, WINDOW_AGAIN, WINDOW)
                s = s[head]
                out.append(np.stack([signed(key[head]), signed(grams.at(s, shape.window)), np.zeros(len(s), np.int64), packed(s + base, np.where(times > 1, EQUALS, 1), kind)]))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            rows, m, t = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            held.clear()
            return merged(rows, m, t, shape)

        for batch in batches:
            ids, ties, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "t", "n"))
            for i in range(batch.num_rows):
                for part in of_text(unpacked(batch.column("text")[i]), shape.again and n[i] > 1):
                    held.append((part, np.full(part.shape[1], ids[i]), np.full(part.shape[1], ties[i])))
                    size += part.shape[1]
            if size >= MERGED_ROWS:
                yield flushed()
                size = 0
        if size:
            yield flushed()

    return mapped(texts.sortWithinPartitions("m", "t"), run, ROWS)


def one_for_equal_neighbours(key: np.ndarray, rh: np.ndarray, a: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal windows in a row, as one token over and over gives, as one run: its first row, its windows, and whether there are several."""
    joins = np.zeros(len(a), bool)
    joins[1:] = (key[1:] == key[:-1]) & (rh[1:] == rh[:-1]) & (count[1:] == 1) & (count[:-1] == 1) & (a[1:] == a[:-1] + 1)
    joins[:: MOST_WINDOWS] = False
    head = np.flatnonzero(~joins)
    sizes = np.diff(np.append(head, len(a)))
    return head, np.where(sizes > 1, sizes, count[head]), sizes > 1


def merged(rows: np.ndarray, m: np.ndarray, t: np.ndarray, shape: Shape) -> pa.RecordBatch:
    """Two rows for equal runs of a batch, one for equal windows; the others are done, and go their way under keys of their own."""
    key, rh, x, al = rows
    order = np.lexsort((m, rh, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (rh[order][1:] == rh[order][:-1])
    heads = np.flatnonzero(~same)
    sizes = np.diff(np.append(heads, len(order)))
    kind = (al >> 16) & 7
    if shape.again:
        goes = same
        reps = order[heads[sizes > 1]]
        kind[reps] = np.where(kind[reps] == WINDOW, WINDOW_AGAIN, kind[reps])
    else:
        goes = m[order] > np.repeat(m[order][heads], sizes)
    # the first of those that would be done stays live: the kernel compares it
    nth = np.cumsum(goes)
    nth -= np.repeat(nth[heads] - goes[heads], sizes)
    done = order[goes & ((nth > 1) | (kind[order] == WINDOW) | (kind[order] == WINDOW_AGAIN))]
    kind[done] = DONE
    key = key.copy()
    key[done] = signed(mix((m[done] ^ al[done]).astype(np.int64).view(_U)))
    high, low = text_keys(t)
    al = (al & ~np.int64(0x7FFFF)) | kind << 16 | low
    return batch_of(key=key, rh=rh, x=x << 32 | high, m=m, al=al)


def in_groups(batches: Iterable[pa.RecordBatch], key: str, least_rows: int) -> Iterator[pa.RecordBatch]:
    """Parts of a sorted stream that hold whole groups of a key, of least_rows rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut).to_batches()[0]
        held, rows = (table.slice(cut).to_batches(), table.num_rows - cut)
        least_rows = max(least_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def resolve(rows: DataFrame, shape: Shape) -> DataFrame:
    """FOUND: windows that go (key 0), and open runs with their anchors' keys.  rows are sorted by key within partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, "key", 50_000):
            out = resolved(*(batch.column(c).to_numpy() for c in ("key", "rh", "x", "m", "al")), shape)
            if out.num_rows:
                yield out

    return mapped(rows, run, FOUND)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted table's row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def resolved(key: np.ndarray, rh: np.ndarray, x: np.ndarray, m: np.ndarray, al: np.ndarray, shape: Shape) -> pa.RecordBatch:
    t = ((x & 0xFFFFFFFF) << 16) | (al & 0xFFFF)
    kind = (al >> 16) & 7
    goes = kind == DONE
    live = np.flatnonzero(~goes)
    order = live[np.lexsort((m[live], rh[live], key[live]))]
    k, r, mm = key[order], rh[order], m[order]
    new = starts_of(k, r)
    which = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order)))
    cold = np.isin(kind[order], (COLD, COLD_AGAIN))
    if shape.again:
        again = np.maximum.reduceat(np.isin(kind[order], (COLD_AGAIN, WINDOW_AGAIN)), heads) if len(heads) else sizes > 1
        gone = ((sizes > 1) | again)[which]
        reps = heads
        # of equal runs the first two are compared; a run that its own text repeats goes at once
        place = np.arange(len(order)) - heads[which]
        pair = cold & ~again[which] & (sizes > 1)[which] & (place < 2)
    else:
        gone = mm > mm[heads][which]
        reps = np.flatnonzero(~gone)
        nth = np.cumsum(gone)
        nth -= (nth[heads] - gone[heads])[which]
        later = cold & gone & (nth == 1)
        pair = later.copy()
        pair[heads[np.unique(which[later])]] = True
    goes[order[gone & ~pair]] = True
    # open too: cold runs, one of each class, that share the part left or right of the anchor with another class of the anchor
    reps = reps[cold[reps]]
    side = x[order[reps]] >> 32
    is_open = np.zeros(len(reps), bool)
    for bits in (side >> 16 & 0xFFFF, side & 0xFFFF):
        by = np.lexsort((r[reps], bits, k[reps]))
        kk, bb, rr = k[reps][by], bits[by], r[reps][by]
        group = np.cumsum(starts_of(kk, bb)) - 1
        first = np.flatnonzero(starts_of(kk, bb))
        if len(first):
            last = np.append(first[1:], len(by)) - 1
            several = rr[first] != rr[last]
            is_open[by] |= several[group] & (bb != 0)
    pair[reps[is_open]] = True
    opened = order[pair]
    settled = np.flatnonzero(goes)
    at = np.concatenate([settled, opened])
    name = np.concatenate([np.zeros(len(settled), np.int64), key[opened]])
    return batch_of(m=m[at], t=t[at], key=name, al=al[at] >> 19)


def contents(joined: DataFrame, shape: Shape) -> DataFrame:
    """CONTENT of the open runs of texts (m, t, text, found: array<struct<key,al>>)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, t = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "t"))
            out: dict[str, list] = {n: [] for n in ("key", "m", "t", "a", "l", "at", "content")}
            for i, (keys, als) in enumerate(found_lists(batch.column("found"))):
                at_open = np.flatnonzero(keys)
                if not len(at_open):
                    continue
                text = unpacked(batch.column("text")[i])
                tokens = shape.tokens(text)
                places = {base + int(f): int(p - f) for base, _, _, place, first, _ in runs_of(tokens, shape) for p, f in zip(place, first, strict=True)}
                for j in at_open.tolist():
                    a, count = int(als[j] >> 13), int(als[j] & 0x1FFF)
                    out["key"].append(int(keys[j]))
                    out["m"].append(int(m[i]))
                    out["t"].append(int(t[i]))
                    out["a"].append(a)
                    out["l"].append(count)
                    out["at"].append(places[a])
                    stop = a + count + shape.window - 1
                    out["content"].append(text[a:stop] if shape.by_byte else tokens[a:stop].tobytes())
            if out["key"]:
                yield batch_of(**{n: pa.array(v, pa.binary() if n == "content" else pa.int32() if n in ("l", "at") else pa.int64()) for n, v in out.items()})

    return mapped(joined, run, CONTENT)


def found_lists(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's structs as two arrays; none for null."""
    names = [column.type.value_type.field(i).name for i in range(2)]
    offsets = column.offsets.to_numpy()
    flat = column.values
    parts = [flat.field(n).to_numpy(zero_copy_only=False) for n in names]
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [tuple(p[a:b] if ok else p[:0] for p in parts) for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid.tolist(), strict=True)]


Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def compare(content: DataFrame, kernel: Kernel) -> DataFrame:
    """RANGES of windows that go, by the kernel: (contents, group numbers, ids, windows, anchor offsets) -> a mask over all windows, row after row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches, "key", 8_000):
            keys, m, t, a, count, at = (batch.column(c).to_numpy() for c in ("key", "m", "t", "a", "l", "at"))
            group = np.cumsum(starts_of(keys)) - 1
            mask = kernel(batch.column("content").to_pylist(), group, m, count, at)
            owner = np.repeat(np.arange(len(keys)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            hit = np.flatnonzero(mask)
            if not len(hit):
                continue
            first = np.ones(len(hit), bool)
            first[1:] = (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])
            heads = np.flatnonzero(first)
            who = owner[hit[heads]]
            yield batch_of(m=m[who], t=t[who], a=a[who] + place[hit[heads]], l=np.diff(np.append(heads, len(hit))))

    return mapped(content, run, RANGES)


def hot_anchors(docs: DataFrame, shape: Shape) -> np.ndarray:
    """Anchors that at least HOT_TEXTS rows of the sample hold, sorted; their number is at most the sample's runs over HOT_TEXTS."""
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, max(SAMPLE_TEXTS, total // ROWS_PER_SAMPLED) / max(total, 1)), seed=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8_slices(batch.column("text"))
            found = [np.unique(h) for i in range(batch.num_rows) for _, _, h, _, _, _ in runs_of(shape.tokens(raw[at[i] : at[i + 1]].tobytes()), shape)]
            if found:
                names, counts = np.unique(np.concatenate(found), return_counts=True)
                yield batch_of(key=signed(names), n=counts)

    counted = mapped(sample, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TEXTS)
    return np.sort(np.array([r["key"] for r in counted.select("key").collect()], np.int64).view(_U))


@dataclass
class Classes:
    """light: a row for each row of the input (doc_id, m0, h1, h2); classes: h1, h2, m, t, n for each distinct text; texts: m, t, n, text (compressed)."""

    light: DataFrame
    classes: DataFrame
    texts: DataFrame


def compressed(rows: DataFrame) -> DataFrame:
    """The rows with their text as compressed UTF-8: texts are shuffled, and read three times after."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            raw, at = utf8_slices(batch.column("text"))
            texts = pa.array([pack(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", texts)

    kinds = ", ".join(f"{n} {'binary' if n == 'text' else k}" for n, k in rows.dtypes)
    return mapped(rows, run, kinds)


def unpacked(text: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text.as_buffer())


def distinct_texts(docs: DataFrame) -> Classes:
    m0 = F.coalesce("doc_id", F.lit(NO_ID))
    h1 = F.xxhash64("text")
    light = docs.select("doc_id", m0.alias("m0"), h1.alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    tie = F.shiftrightunsigned("h1", 16)
    classes = light.groupBy("h1", "h2").agg(F.min("m0").alias("m"), F.count("*").alias("n")).withColumn("t", tie)
    full = compressed(docs.select(m0.alias("m0"), F.shiftrightunsigned(h1, 16).alias("t0"), "text"))
    reps = classes.select("m", "t", "n").hint("shuffle_hash")
    texts = full.join(reps, (F.col("m0") == F.col("m")) & (F.col("t0") == F.col("t"))).select("m", "t", "n", "text")
    return Classes(light, classes, texts)


def repeated_windows(texts: DataFrame, shape: Shape, hot: np.ndarray, kernel: Kernel) -> DataFrame:
    """texts with found (array<struct<key,al>>, those with key 0 go) and more (array<struct<a,l>>): windows that go."""
    rows = anchors(texts, shape, hot)
    met = rows.repartition("key").sortWithinPartitions("key")
    found = resolve(met, shape).groupBy("m", "t").agg(F.collect_list(F.struct("key", "al")).alias("found")).hint("shuffle_hash")
    content = contents(texts.join(found, ["m", "t"]).select("m", "t", "text", "found"), shape)
    more = compare(content.repartition("key").sortWithinPartitions("key"), kernel)
    more = more.groupBy("m", "t").agg(F.collect_list(F.struct("a", "l")).alias("more")).hint("shuffle_hash")
    return texts.join(found, ["m", "t"], "left").join(more, ["m", "t"], "left").select("m", "t", "n", "text", "found", "more")


def covered(size: int, shape: Shape, text: bytes, found: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tokens of a text, size in number, under windows that go."""
    gone = found[1][found[0] == 0]
    a = np.concatenate([gone >> 13, more[0]]).astype(np.int64)
    count = np.concatenate([gone & 0x1FFF, more[1]]).astype(np.int64)
    some = count == EQUALS
    if some.any():
        hashes = Grams(shape.tokens(text)).all(shape.window)
        equal = np.flatnonzero(np.isin(hashes, hashes[a[some]]))
        a, count = np.append(a[~some], equal), np.append(count[~some], np.ones(len(equal), np.int64))
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, a, 1)
    np.add.at(steps, a + count + shape.window - 1, -1)
    return np.cumsum(steps[:-1]) > 0
