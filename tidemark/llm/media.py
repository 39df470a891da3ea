"""Texts as baseline JPEG images, and features read back from the stored bytes.

Storage.  A payload byte b becomes one 8x8 block whose only coefficient is DC:
with quantiser 8 the block's samples are all b, so a decoder gets the bytes back
exactly.  A row of blocks is 64 wide and ends with a restart marker, so entropy
coding starts afresh every 64 bytes; AC codes are a single end-of-block bit.  A payload over
``FRAME_ROWS`` rows goes into several images, one after the other.

Reading.  ``decode_dc`` is a general reader of baseline JPEG: it parses the
markers (quantisers, Huffman tables, frame, scan, restart interval), then
Huffman-decodes the scans of all images of a batch together, one symbol for each
restart segment at a time, in numpy.  AC coefficients are skipped, not transformed:
the DC plane of the luminance component is the image at an eighth of its size, from which the
thumbnail and its hash come.  Images that are not baseline raise ``ValueError``.

Defined results: a null text is an empty one, stored as 64 zero bytes; equal texts give equal
values; ids may be null or repeat; an empty table gives no rows; very long texts go into images of ``FRAME_ROWS`` rows, one group of images
in memory at a time; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import batch_of, groups_of, id_text, map_batches, utf8_slices

UNIT = 64
FRAME_ROWS = 8128
GROUP_BYTES = 1 << 20
THUMB = 8
#: Number of DC codes of each length from 1 to 16, and their categories (JPEG's usual luminance table).
DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: One AC code of one bit: end of block.
AC_LENGTHS = (1,) + (0,) * 15
AC_VALUES = (0,)
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def codes(lengths: tuple[int, ...], values: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """value -> (code, bits), as the format builds them: counting up within a length, doubling between."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for v in values[at : at + n]:
            out[v] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255: code, magnitude and end of block as one number, and its bits."""
    dc = codes(DC_LENGTHS, DC_VALUES)
    word, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        magnitude = d if d >= 0 else d + (1 << size) - 1
        word[d + 255] = ((code << size) | magnitude) << 1  # the last bit is the end of block, 0
        bits[d + 255] = n + size + 1
    return word, bits


_WORD, _BITS = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


def _head(rows: int) -> bytes:
    def table(kind: int, lengths: tuple[int, ...], values: tuple[int, ...]) -> bytes:
        return bytes((kind,)) + bytes(lengths) + bytes(values)

    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8]) * 64),
        _segment(0xC0, b"\x08" + (rows * 8).to_bytes(2, "big") + (UNIT * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, table(0x00, DC_LENGTHS, DC_VALUES)),
        _segment(0xC4, table(0x10, AC_LENGTHS, AC_VALUES)),
        _segment(0xDD, UNIT.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _entropy(rows: np.ndarray) -> list[bytes]:
    """Each row of 64 payload bytes as its stuffed entropy-coded segment."""
    wide = rows.astype(np.int64)
    diff = np.diff(wide - 128, axis=1, prepend=0) + 255
    bits = _BITS[diff]
    ends = np.cumsum(bits, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    base = np.concatenate(([0], np.cumsum(sizes)))
    # each code is at most 17 bits: it touches three bytes at most
    place = base[:-1, None] * 8 + ends - bits
    at, shift = place >> 3, 24 - (place & 7) - bits
    word = _WORD[diff] << shift
    out = np.zeros(int(base[-1]) + 3, np.int64)
    n = len(out)
    for k in range(3):
        out += np.bincount((at + k).ravel(), ((word >> (16 - 8 * k)) & 0xFF).ravel(), n).astype(np.int64)
    pad = sizes * 8 - ends[:, -1]
    out[base[1:] - 1] |= (1 << pad) - 1
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def encode(payload: np.ndarray) -> bytes:
    """The payload, a positive multiple of 64 bytes, as one or more JPEG images."""
    return encode_group([payload])[0]


def encode_group(payloads: list[np.ndarray]) -> list[bytes]:
    parts = _entropy(np.concatenate(payloads).reshape(-1, UNIT))
    out, at = [], 0
    for p in payloads:
        rows = len(p) // UNIT
        images = []
        for top in range(0, rows, FRAME_ROWS):
            here = parts[at + top : at + min(rows, top + FRAME_ROWS)]
            scan = [_head(len(here))]
            for i, part in enumerate(here):
                scan.append(part)
                scan.append(bytes((0xFF, 0xD0 + i % 8)) if i + 1 < len(here) else b"\xff\xd9")
            images.append(b"".join(scan))
        out.append(b"".join(images))
        at += rows
    return out


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    quants: dict[int, int] = field(default_factory=dict)  # quantiser of DC
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    parts: list[Component] = field(default_factory=list)
    restart: int = 0
    scan: tuple[int, int] = (0, 0)


def parse(data: bytes) -> list[Image]:
    """Markers of the baseline images in data, which follow one another."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = Image(), at + 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("broken marker")
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
                continue
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if size < 2 or at > len(data):
                raise ValueError("broken segment")
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quants[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image.tables[body[0]] = tuple(body[1:17]), tuple(body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("samples are not of 8 bits")
                image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                image.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline image")
            elif marker == 0xDD:
                image.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                for i in range(1, 1 + 2 * body[0], 2):
                    part = next(p for p in image.parts if p.ident == body[i])
                    part.dc, part.ac = body[i + 1] >> 4, 16 + (body[i + 1] & 15)
                if body[0] != len(image.parts):
                    raise ValueError("components in several scans")
                break
        start = at
        while True:  # to the marker after the scan: FF that neither stuffing nor a restart follows
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise ValueError("no end of image")
            if data[at + 1] == 0xD9:
                break
            if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
                raise ValueError("a second scan")
            at += 2
        image.scan = (start, at)
        images.append(image)
        at += 2
    return images


def _lookup(lengths: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """For each 16-bit window: bits << 8 | value of the code that it begins with; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    for value, (code, bits) in codes(lengths, values).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | value
    return out


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _tables_of(image: Image) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Lookups of all the image's tables in one array, and for each block of a unit its (DC, AC) places there."""
    kinds = sorted(image.tables)
    key = tuple((k, image.tables[k]) for k in kinds)
    if key not in _LOOKUPS:
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[key] = np.concatenate([_lookup(*image.tables[k]) for k in kinds])
    place = {k: i << 16 for i, k in enumerate(kinds)}
    return _LOOKUPS[key], [(place[p.dc], place[p.ac]) for p in image.parts for _ in range(p.across * p.down if len(image.parts) > 1 else 1)]


def _grid(image: Image) -> tuple[int, int]:
    """Units across and down."""
    across = max(p.across for p in image.parts) if len(image.parts) > 1 else 1
    down = max(p.down for p in image.parts) if len(image.parts) > 1 else 1
    return -(-image.width // (8 * across)), -(-image.height // (8 * down))


def decode_dc(datas: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each byte string its images, each with the luminance plane of DC values (samples at an eighth of the size)."""
    work = [(i, data, image) for i, data in enumerate(datas) for image in parse(data)]
    out: list[list[tuple[Image, np.ndarray]]] = [[] for _ in datas]
    groups: dict[tuple, list[int]] = {}
    for w, (_, _, image) in enumerate(work):
        key = tuple(sorted(image.tables.items())), tuple((p.across, p.down, p.dc, p.ac) for p in image.parts)
        groups.setdefault(key, []).append(w)
    planes: dict[int, np.ndarray] = {}
    for members in groups.values():
        for w, plane in zip(members, _decode_alike([work[w][1:] for w in members]), strict=True):
            planes[w] = plane
    for w, (i, _, image) in enumerate(work):
        out[i].append((image, planes[w]))
    return out


def _decode_alike(work: list[tuple[bytes, Image]]) -> list[np.ndarray]:
    """DC planes of images that share tables and layout: all restart segments advance together."""
    lookup, blocks = _tables_of(work[0][1])
    per_unit = len(blocks)
    streams, starts, counts, firsts, total, base = [], [], [], [], 0, 0
    for data, image in work:
        units = int(np.prod(_grid(image)))
        scan = np.frombuffer(data, np.uint8)[image.scan[0] : image.scan[1]]
        escape = np.flatnonzero(scan[:-1] == 0xFF) if len(scan) else np.empty(0, np.int64)
        drop = np.zeros(len(scan), bool)
        drop[escape + 1] = True
        resets = escape[scan[escape + 1] != 0]
        drop[resets] = True
        clean = scan[~drop]
        cuts = np.concatenate(([0], resets - np.cumsum(drop)[resets] + 1)) if len(resets) else np.zeros(1, np.int64)
        step = image.restart or max(units, 1)
        n = -(-units // step)
        if len(cuts) < n:
            raise ValueError("restart segments are missing")
        starts.append(base + cuts[:n])
        size = np.full(n, step, np.int64)
        size[-1] = units - step * (n - 1)
        counts.append(size * per_unit)
        firsts.append(total + np.arange(n) * step * per_unit)
        streams.append(clean)
        base += len(clean)
        total += units * per_unit
    data = np.concatenate([*streams, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # 32 bits from each byte on
    pos = np.concatenate(starts) * 8
    left, slot = np.concatenate(counts), np.concatenate(firsts)
    last = len(window) - 1
    dc_at = np.array([d for d, _ in blocks], np.int64)
    ac_at = np.array([a for _, a in blocks], np.int64)
    diffs = np.zeros(total, np.int64)
    block = np.zeros(len(pos), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        """25 bits or more are good from each place on, at the top of 32."""
        return (window[np.minimum(p >> 3, last)] << (p & 7)) & 0xFFFFFFFF

    def symbols(p: np.ndarray, table: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        got = lookup[table + (peek(p) >> 16)]
        if not got.all():
            raise ValueError("no such Huffman code")
        return got & 0xFF, p + (got >> 8)

    active = np.flatnonzero(left > 0)
    while len(active):
        which = block[active] % per_unit if per_unit > 1 else 0
        size, p = symbols(pos[active], dc_at[which])
        magnitude = (peek(p) >> (32 - size)) if per_unit else size
        low = (magnitude < (1 << np.maximum(size - 1, 0))) & (size > 0)
        diffs[slot[active]] = np.where(low, magnitude - (1 << size) + 1, np.where(size > 0, magnitude, 0))
        p = p + size
        k = np.ones(len(active), np.int64)
        todo = np.arange(len(active))
        table = ac_at[which] if per_unit > 1 else ac_at[0]
        while len(todo):  # AC: run and size; 0 ends the block, F0 skips 16
            value, q = symbols(p[todo], table[todo] if per_unit > 1 else table)
            p[todo] = q + (value & 15)
            k[todo] += np.where(value == 0xF0, 16, (value >> 4) + 1)
            todo = todo[(value != 0) & (k[todo] < 64)]
        pos[active] = p
        slot[active] += 1
        block[active] += 1
        left[active] -= 1
        active = active[left[active] > 0] if (left[active] == 0).any() else active
    out, at, seg = [], 0, 0
    for (_, image), size in zip(work, counts, strict=True):
        n = int(size.sum())
        out.append(_plane(image, diffs[at : at + n], size, blocks))
        at += n
        seg += len(size)
    return out


def _plane(image: Image, diffs: np.ndarray, sizes: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The luminance plane: running sums of each segment's differences of the first component, times the quantiser, over 8."""
    first, per_unit = image.parts[0], len(blocks)
    h, v = (first.across, first.down) if len(image.parts) > 1 else (1, 1)
    across, down = _grid(image)
    own = diffs.reshape(-1, per_unit)[:, : h * v].ravel()
    ends = np.cumsum(sizes // per_unit * h * v)
    total = np.cumsum(own)
    before = np.concatenate(([0], total[ends[:-1] - 1])) if len(ends) else np.zeros(0, np.int64)
    dc = total - np.repeat(before, np.diff(ends, prepend=0))
    level = np.clip(dc * image.quants[first.quant] // 8 + 128, 0, 255).astype(np.uint8)
    return level.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def thumbnail(plane: np.ndarray, size: int = THUMB) -> np.ndarray:
    """Means over a grid of size x size parts; small planes repeat their rows or columns."""
    rows = np.linspace(0, plane.shape[0], size + 1).astype(np.int64)
    cols = np.linspace(0, plane.shape[1], size + 1).astype(np.int64)
    total = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1), np.int64)
    total[1:, 1:] = plane.cumsum(0, dtype=np.int64).cumsum(1)
    r0, c0 = rows[:-1], cols[:-1]
    r1, c1 = np.maximum(rows[1:], r0 + 1), np.maximum(cols[1:], c0 + 1)
    area = (r1 - r0)[:, None] * (c1 - c0)[None]
    box = lambda r, c: total[np.ix_(r, c)]
    return (box(r1, c1) - box(r0, c1) - box(r1, c0) + box(r0, c0)) // area


def thumbnail_hash(thumb: np.ndarray) -> str:
    """One bit for each part: set if it is lighter than the mean."""
    bits = (thumb * thumb.size > thumb.sum()).ravel()
    return np.packbits(bits).tobytes().hex()


def payload_of(text: np.ndarray) -> np.ndarray:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    out = np.zeros(size, np.uint8)
    out[: len(text)] = text
    return out


def features_of(n_bytes: list[int], stored: list[bytes]) -> list[tuple]:
    """What is read back from the stored bytes alone, but for the unpadded length."""
    out = []
    for n, media, images in zip(n_bytes, stored, decode_dc(stored), strict=True):
        plane = images[0][1] if len(images) == 1 else np.concatenate([p for _, p in images])
        payload = plane.tobytes()
        width, height = images[0][0].width, sum(i.height for i, _ in images)
        feature = f"{width}x{height}:{thumbnail_hash(thumbnail(plane))}"
        out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, width, height))
    return out


def encode_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = utf8_slices(batch.column("text"))
    media: list[bytes] = []
    for a, b in groups_of(np.diff(at), GROUP_BYTES):
        media += encode_group([payload_of(raw[at[i] : at[i + 1]]) for i in range(a, b)])
    return batch_of(doc_id=batch.column("doc_id"), n_bytes=np.diff(at), media=pa.array(media, pa.binary()))


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text stored as baseline JPEG."""
    return map_batches(id_text(df, id_col, text_col), encode_batch, "doc_id long, n_bytes long, media binary")


def feature_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, media = batch.column("n_bytes").to_pylist(), batch.column("media")
    rows: list[tuple] = []
    for a, b in groups_of(np.asarray(sizes), GROUP_BYTES):
        rows += features_of(sizes[a:b], [m.as_py() for m in media[a:b]])
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
    return batch_of(doc_id=batch.column("doc_id"), **{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def media_features(stored: DataFrame) -> DataFrame:
    """Features of a media table; only the stored bytes are read."""
    return map_batches(stored.select("doc_id", "n_bytes", "media"), feature_batch, SCHEMA)


def store_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``media_features(media_table(df))`` in one pass over the batches."""
    return map_batches(id_text(df, id_col, text_col), lambda batch: feature_batch(encode_batch(batch)), SCHEMA)
