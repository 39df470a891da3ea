"""Secrets in texts: three plain patterns, and candidates confirmed by their structure.

Base kinds, found leftmost first and without overlap within a kind: ``assign``
(a name such as ``password`` with a value of six signs or more), ``access``
(``AKIA`` ids of 20 signs or more) and ``hex`` (24 lower-case hex digits or more).

The method's own kinds are reported only when decoding confirms them: ``jwt``
(a signed token whose first part decodes to a JSON object with ``alg``), ``der``
(base64 or hex that decodes to a private key's nested DER lengths: PKCS#1, PKCS#8
or SEC 1) and ``ssh`` (base64 that decodes to the length-prefixed fields of an
``openssh-key-v1`` file).  Keys may be bare, or between PEM lines.

Places are code points, ends exclusive.  One pass over Arrow batches, no shuffle.
A cheap test on bytes (long runs of token signs, the names in lower case, a PEM
line) leaves the patterns only texts that can hold a match.

Defined results: a null text is an empty one, with no spans; rows are independent, so repeated
rows repeat their result; ids may be null; an empty table gives no rows; very long texts are scanned whole, in memory of a few
times their size; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import batch_of, id_text, map_batches, utf8_slices

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
RUN64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
RUN16 = re.compile(r"(?<![A-Za-z0-9+/])[0-9A-Fa-f]{64,}(?![A-Za-z0-9+/])")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
SSH_MAGIC = b"openssh-key-v1\0"
#: Shortest run of token signs that any pattern but assign needs.
SHORTEST_RUN = 12
SCHEMA = "doc_id long, kinds array<string>, starts array<int>, stops array<int>"

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")] = True


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, byte after) of the DER item at ``at``, if its length fits."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        width = size & 0x7F
        if not 1 <= width <= 4 or at + width > end:
            return None
        size = int.from_bytes(data[at : at + width], "big")
        at += width
    return (tag, at, at + size) if at + size <= end else None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill [at, end) exactly."""
    found = []
    while at < end:
        item = der_item(data, at, end)
        if item is None:
            return None
        found.append(item)
        at = item[2]
    return found


def is_private_der(data: bytes) -> bool:
    outer = der_item(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    items = der_items(data, outer[1], outer[2])
    if not items or len(items) < 2 or items[0][0] != 0x02:
        return False
    tags = [t for t, _, _ in items]
    version = int.from_bytes(data[items[0][1] : items[0][2]], "big")
    if version in (0, 1) and len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):  # PKCS#1
        return True
    if version in (0, 1) and tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
        inner = der_items(data, items[1][1], items[1][2])
        return bool(inner) and inner[0][0] == 0x06
    return version == 1 and tags[1] == 0x04 and 16 <= items[1][2] - items[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])  # SEC 1


def is_ssh_key(data: bytes) -> bool:
    """The magic, three length-prefixed names, a count of keys, then so many public blobs and one private blob."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def field() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (field() and field() and field()) or at + 4 > len(data):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(field() for _ in range(keys + 1))


def decoded64(text: str, *, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "ssh" if is_ssh_key(data) else "der" if is_private_der(data) else None


def is_signed_token(head: str, body: str) -> bool:
    try:
        top, claims = (json.loads(decoded64(x, url=True) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(top, dict) and isinstance(top.get("alg"), str) and isinstance(claims, dict)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, stop) of every span, in that order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    found += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    keys = {}
    for m in RUN16.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            keys[m.start()] = (kind, m.end())
    for m in RUN64.finditer(text):
        if kind := key_kind(decoded64(m[0])):
            keys[m.start()] = (kind, m.end())
    for m in PEM.finditer(text):
        if kind := key_kind(decoded64("".join(m[2].split()))):
            keys[m.start()] = (kind, m.end())
    found += [(at, KINDS.index(kind), stop) for at, (kind, stop) in keys.items()]
    return sorted(found)


def may_hold(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with a run of token signs long enough for any pattern but assign."""
    first, last = int(at[0]), int(at[-1])
    breaks = np.flatnonzero(~_SIGNS[raw[first:last]])
    edges = np.concatenate(([-1], breaks, [last - first]))
    long = np.flatnonzero(np.diff(edges) > SHORTEST_RUN)
    flags = np.zeros(len(at), np.int64)
    # a long run marks each row that it touches
    lo = np.searchsorted(at - first, edges[long] + 1, "right") - 1
    hi = np.searchsorted(at - first, edges[long + 1] - 1, "right") - 1
    np.add.at(flags, lo, 1)
    np.add.at(flags, np.minimum(hi + 1, len(flags) - 1), -1)
    return np.cumsum(flags)[:-1] > 0


def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = utf8_slices(batch.column("text"))
    flags = may_hold(raw, at) if len(at) > 1 and at[-1] > at[0] else np.zeros(len(at) - 1, bool)
    kinds, starts, stops = [], [], []
    for i in range(batch.num_rows):
        data = raw[at[i] : at[i + 1]].tobytes()
        found: list[tuple[int, int, int]] = []
        low = None if flags[i] else data.lower()
        if flags[i] or b"-----BEGIN" in data or any(n in low for n in NAMES):
            found = find(data.decode("utf-8", "replace"))
        kinds.append([KINDS[k] for _, k, _ in found])
        starts.append([s for s, _, _ in found])
        stops.append([e for _, _, e in found])
    ints = pa.list_(pa.int32())
    return batch_of(doc_id=batch.column("doc_id"), kinds=pa.array(kinds, pa.list_(pa.string())), starts=pa.array(starts, ints), stops=pa.array(stops, ints))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kinds, starts, stops: the spans of each row by start, then kind as listed."""
    return map_batches(id_text(df, id_col, text_col), scan_batch, SCHEMA)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with each span, and what overlaps it, as one mark."""
    out, at = [], 0
    for start, _, stop in find(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def digest_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = [batch.column(n).to_pylist() for n in ("kinds", "starts", "stops")]
    counts = {k: [] for k in KINDS[:3]}
    sums, shown = [], []
    for kinds, starts, stops in zip(*columns, strict=True):
        spans = [f"{k}:{a}:{b}" for k, a, b in zip(kinds, starts, stops, strict=True)]
        base = ",".join(s for k, s in zip(kinds, spans, strict=True) if k in counts)
        for k, out in counts.items():
            out.append(kinds.count(k))
        sums.append(hashlib.sha256(base.encode()).hexdigest())
        shown.append(",".join(spans))
    return batch_of(doc_id=batch.column("doc_id"), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, base_sha256=sums, spans=shown)


def digest(spans: DataFrame) -> DataFrame:
    return map_batches(spans, digest_batch, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted_rows(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of docs, all columns as they are but for the text, in which each span is the mark; a null text stays null."""
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        spans = scan_batch(batch_of(doc_id=pa.nulls(batch.num_rows, pa.int64()), text=pa.array([t or "" for t in texts], pa.string())))
        hit = [bool(k) for k in spans.column("kinds").to_pylist()]
        new = pa.array([redact(t, mark) if h else t for t, h in zip(texts, hit, strict=True)], batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_batches(docs, run, docs.schema)
