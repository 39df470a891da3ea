"""Removal of repeated passages of words, level by level.

A word goes if a window of ``WINDOW`` words that covers it also starts in a row with a smaller id.
Levels double: an anchor of 4 words that occurs once is settled; one that recurs is extended to 8, by the four
words left or right of it; where these recur too, windows grow in the kernel from 1 over 2 and 4 to 8 words and at last to 13, and at
each level only windows that occurred twice at the one before are extended.

Words are told apart by 64 bits of hash.

Defined results: a null text has no words; texts shorter than a window keep all; of equal texts
the one with the least id counts as the first; a null id comes after all others, and rows with equal ids
are not earlier than one another, so repeated rows keep alike; an empty table gives no
rows; other columns are ignored.  Windows are judged on the input and never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import windows
from tidemark.llm.frames import batch_of, free_names, id_text, mapped

WINDOW = 13
GRAM = 4
RESULT = "m long, t long, n_words long, n_removed long, kept_sha256 string"


def word_tokens(text: bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def shape_of(window: int = WINDOW, gram: int = GRAM) -> windows.Shape:
    return windows.Shape(window, gram, (window - gram) // 2, word_tokens, "earlier")


def levels(window: int) -> list[int]:
    """1, 2, 4 and so on, and the window's length last."""
    out = [1]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def repeated_names(words: np.ndarray, room: np.ndarray, window: int) -> np.ndarray:
    """A number for each place whose window occurs at another place too, equal for equal windows; -1 elsewhere.

    room: words from each place to the end of its text.
    """
    names = np.full(len(words), -1, np.int64)
    alive, value, before = np.flatnonzero(room >= 1), None, 0
    for size in levels(window):
        alive = alive[room[alive] >= size]
        if before:
            second = names[alive + size - before]
            alive = alive[second >= 0]
            value = names[alive].astype(np.uint64) << np.uint64(32) | second[second >= 0].astype(np.uint64)
        else:
            value = words[alive]
        _, which, counts = np.unique(value, return_inverse=True, return_counts=True)
        twice = counts[which] > 1
        names = np.full(len(words), -1, np.int64)
        names[alive[twice]] = which[twice]
        alive, before = alive[twice], size
    return names


def kernel_of(window: int) -> windows.Kernel:
    def kernel(contents: list[bytes], group: np.ndarray, m: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        words = np.frombuffer(b"".join(contents), np.uint64)
        sizes = count.astype(np.int64) + window - 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        names = repeated_names(words, ends[owner] - np.arange(len(words)), window)
        hit = np.flatnonzero(names >= 0)
        first = np.full(int(names.max(initial=-1)) + 1, windows.NO_ID)
        np.minimum.at(first, names[hit], m[owner[hit]])
        gone = np.zeros(len(words), bool)
        gone[hit] = m[owner[hit]] > first[names[hit]]
        starts = np.arange(len(words)) - (ends - sizes)[owner] < count[owner]
        return gone[starts]

    return kernel


def removed_words(joined: DataFrame, shape: windows.Shape, with_text: bool = False) -> DataFrame:
    """RESULT for distinct texts; with_text: and what is left, the text itself where nothing goes, else the kept words with single spaces."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, more = windows.found_lists(batch.column("found")), windows.found_lists(batch.column("more"))
            rows = []
            for i in range(batch.num_rows):
                text = windows.unpacked(batch.column("text")[i])
                words = text.split()
                gone = windows.covered(len(words), shape, text, found[i], more[i])
                n = int(gone.sum())
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
                rows.append((len(words), n, hashlib.sha256(kept).hexdigest(), (kept if n else text).decode() if with_text else ""))
            names = ("n_words", "n_removed", "kept_sha256") + (("kept",) if with_text else ())
            yield batch_of(m=batch.column("m"), t=batch.column("t"), **{k: pa.array([r[j] for r in rows]) for j, k in enumerate(names)})

    return mapped(joined, run, RESULT + (", kept string" if with_text else ""))


def by_text(docs: DataFrame, window: int, gram: int, with_text: bool) -> tuple[windows.Classes, DataFrame]:
    """The classes of equal texts, and for the first row (m, t) of each the result of removal."""
    shape = shape_of(window, gram)
    classes = windows.distinct_texts(docs)
    joined = windows.repeated_windows(classes.texts, shape, windows.hot_anchors(docs, shape), kernel_of(window))
    return classes, removed_words(joined, shape, with_text).dropDuplicates(["m", "t"])


def repeated_passages(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    classes, results = by_text(id_text(df, id_col, text_col), window, gram, with_text=False)
    named = classes.classes.select("h1", "h2", "m", "t").join(results, ["m", "t"]).drop("t")
    again = is_later(window)
    return classes.light.join(named, ["h1", "h2"]).select(
        "doc_id",
        "n_words",
        F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def is_later(window: int) -> Column:
    """A later row than the first of its text loses every window."""
    return (F.col("m0") > F.col("m")) & (F.col("n_words") >= window)


def without_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are but for the text, from which repeated passages are gone; a null text stays null."""
    classes, results = by_text(id_text(docs, id_col, text_col), window, gram, with_text=True)
    h1, h2, m0, no_text, c1, c2, m, t, m1, t1, words, kept = free_names(docs, 12)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = {h1: F.xxhash64(text), h2: F.xxhash64(F.lit(7), text), m0: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(windows.NO_ID)), no_text: F.col(f"`{text_col}`").isNull()}
    rows = docs.withColumns(keys).drop(text_col)
    named = classes.classes.select(F.col("h1").alias(c1), F.col("h2").alias(c2), F.col("m").alias(m), F.col("t").alias(t))
    found = results.select(F.col("m").alias(m1), F.col("t").alias(t1), F.col("n_words").alias(words), F.col("kept").alias(kept))
    joined = rows.join(named, (F.col(h1) == F.col(c1)) & (F.col(h2) == F.col(c2))).join(found, (F.col(m) == F.col(m1)) & (F.col(t) == F.col(t1)))
    later = (F.col(m0) > F.col(m)) & (F.col(words) >= window)
    left = F.when(~F.col(no_text), F.when(later, F.lit("")).otherwise(F.col(kept)))
    return joined.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
