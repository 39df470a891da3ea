"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else, in the same
text or another.  Suffixes are ordered only through that many bytes, most significant digit first: the
leading digit is the suffix's anchor and offset (see ``windows``), by which the rows are shuffled, and the next are eight
bytes each.  After every pass a group of one is dropped, so groups that are left after the last are exactly the
repeated windows.

Defined results: a null text is an empty one; texts shorter than a window keep all; repeated rows
and equal texts of a window or more lose all bytes; ids may be null and play no part; an empty table gives no rows; other
columns are ignored.  Strings are judged on the input and never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import windows
from tidemark.llm.frames import batch_of, id_text, mapped

WINDOW = 200
GRAM = 40
DIGIT = 8
RESULT = "m long, t long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

#: A number for each byte value, all alike random.
_BYTES = windows.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_tokens(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


def shape_of(window: int = WINDOW, gram: int = GRAM) -> windows.Shape:
    return windows.Shape(window, gram, -(-(window - gram) // 2), byte_tokens, "again", by_byte=True)


def digits(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on as one number, the first the most significant; zeros after the end."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(DIGIT):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def radix_groups(lead: np.ndarray, place: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes of data at the given places share their lead and their first depth bytes with another one."""
    values = digits(data)
    order = np.argsort(lead, kind="stable")
    group = np.cumsum(windows.starts_of(lead[order]))
    for at in (None, *range(0, depth, DIGIT)):
        if at is not None:
            # the last digit ends at the depth: it may overlap the one before
            digit = values[place[order] + min(at, depth - DIGIT)]
            mixed = np.zeros(len(order), bool)
            differ = np.flatnonzero((digit[1:] != digit[:-1]) & (group[1:] == group[:-1]))
            if len(differ):
                uneven = np.zeros(int(group[-1]) + 1, bool)
                uneven[group[differ]] = True
                mixed = uneven[group]
                some = np.flatnonzero(mixed)
                by = some[np.lexsort((digit[some], group[some]))]
                order[some], digit[some] = order[by], digit[by]
                group = np.cumsum(windows.starts_of(group, digit))
        alone = windows.starts_of(group) if len(group) else np.zeros(0, bool)
        alone &= np.append(alone[1:], True)
        order, group = order[~alone], group[~alone]
        if not len(order):
            break
    out = np.zeros(len(lead), bool)
    out[order] = True
    return out


def kernel_of(window: int) -> windows.Kernel:
    def kernel(contents: list[bytes], group: np.ndarray, m: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(contents), np.uint8)
        begin = np.cumsum([0, *map(len, contents[:-1])])
        owner = np.repeat(np.arange(len(contents)), count)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        lead = group[owner].astype(np.int64) * (window + 1) + (at[owner] - place)
        return radix_groups(lead, begin[owner] + place, data, window)

    return kernel


def without(text: bytes, gone: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and what is left."""
    n = int(gone.sum())
    if not n:
        return 0, 0, text
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return n, runs, np.frombuffer(text, np.uint8)[~gone].tobytes()


def removed_bytes(joined: DataFrame, shape: windows.Shape) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, more = windows.found_lists(batch.column("found")), windows.found_lists(batch.column("more"))
            rows = []
            for i, n in enumerate(batch.column("n").to_pylist()):
                text = windows.unpacked(batch.column("text")[i])
                if n > 1 and len(text) >= shape.window:
                    gone = np.ones(len(text), bool)
                else:
                    gone = windows.covered(len(text), shape, text, found[i], more[i])
                n_removed, spans, kept = without(text, gone)
                rows.append((len(text), n_removed, spans, hashlib.sha256(kept).hexdigest()))
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
            yield batch_of(m=batch.column("m"), t=batch.column("t"), **{k: pa.array([r[j] for r in rows]) for j, k in enumerate(names)})

    return mapped(joined, run, RESULT)


def repeated_bytes(df: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    docs = id_text(df, id_col, text_col)
    shape = shape_of(window, gram)
    classes = windows.distinct_texts(docs)
    joined = windows.repeated_windows(classes.texts, shape, windows.hot_anchors(docs, shape), kernel_of(window))
    results = removed_bytes(joined, shape).dropDuplicates(["m", "t"])
    named = classes.classes.select("h1", "h2", "m", "t").join(results, ["m", "t"]).drop("m", "t")
    return classes.light.join(named, ["h1", "h2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
