"""Operators that treat each row alone: media, secrets, personal data, pieces."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import media, pieces, pii, secrets

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def text_rows(tricky):
    return [(i, t or "") for i, t in tricky]


# -- media


def test_media_round_trip(docs, tricky, none):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.store_and_read(docs).collect())
    expected = Counter()
    for i, t in text_rows(tricky):
        data = t.encode()
        p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        expected[i, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == expected
    assert media.store_and_read(none).count() == 0
    one, two = media.media_features(media.media_table(docs)), media.store_and_read(docs)
    assert Counter(one.collect()) == Counter(two.collect())
    by_text = {}
    for r in two.collect():
        assert by_text.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_media_any_bytes(data):
    payload = media.payload_of(np.frombuffer(data, np.uint8))
    ((image, plane),) = media.decode_dc([media.encode(payload)])[0]
    assert plane.tobytes() == payload.tobytes() and image.width == 512


def test_media_long_payload_takes_several_images():
    payload = np.random.default_rng(0).integers(0, 256, 64 * (media.FRAME_ROWS + 3)).astype(np.uint8)
    images = media.decode_dc([media.encode(payload)])[0]
    assert len(images) == 2 and b"".join(p.tobytes() for _, p in images) == payload.tobytes()


def jpeg(parts, units, across, down, restart=0):
    """A baseline image with random AC codes, written bit by bit: (bytes, DC differences by block)."""
    rnd = np.random.default_rng(3)
    ac_lengths, ac_values = (0, 2, 2) + (0,) * 13, (0x00, 0x11, 0xF0, 0x53)
    dc, ac = media.codes(media.DC_LENGTHS, media.DC_VALUES), media.codes(ac_lengths, ac_values)
    segment = lambda m, b: bytes((0xFF, m)) + (len(b) + 2).to_bytes(2, "big") + b
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([16]) + bytes(63)) + segment(0xDB, b"\1" + bytes([8]) + bytes(63))
    width, height = 8 * across * max(p[1] for p in parts), 8 * down * max(p[2] for p in parts)
    head += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes((i, h << 4 | v, q)) for i, h, v, q in parts))
    head += segment(0xC4, b"\0" + bytes(media.DC_LENGTHS) + bytes(media.DC_VALUES)) + segment(0xC4, b"\x10" + bytes(ac_lengths) + bytes(ac_values))
    head += segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    head += segment(0xDA, bytes([len(parts)]) + b"".join(bytes((p[0], 0)) for p in parts) + b"\0\x3f\0")
    bits, body, marks, levels = "", b"", 0, []
    last = dict.fromkeys((p[0] for p in parts), 0)

    def flush():
        nonlocal bits, body
        bits += "1" * (-len(bits) % 8)
        body += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    for u in range(units):
        if restart and u and u % restart == 0:
            flush()
            body += bytes((0xFF, 0xD0 + marks % 8))
            marks, last = marks + 1, dict.fromkeys(last, 0)
        for i, h, v, _ in parts:
            for _ in range(h * v if len(parts) > 1 else 1):
                value = int(rnd.integers(-60, 60))
                diff, last[i] = value - last[i], value
                size = abs(diff).bit_length()
                code, n = dc[size]
                bits += f"{code:0{n}b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")
                if i == parts[0][0]:
                    levels.append(value)
                k = 1
                while k < 64 and rnd.random() < 0.5:
                    symbol = (0x11, 0xF0, 0x53)[rnd.integers(3)]
                    step = 16 if symbol == 0xF0 else (symbol >> 4) + 1
                    if k + step > 63:
                        break
                    code, n = ac[symbol]
                    bits += f"{code:0{n}b}" + "01010"[: symbol & 15]
                    k += step
                code, n = ac[0]
                bits += f"{code:0{n}b}"
    flush()
    return head + body + b"\xff\xd9", levels


@pytest.mark.parametrize("restart", [0, 2, 3])
def test_media_reads_other_baseline_images(restart):
    data, levels = jpeg([(1, 2, 2, 0), (2, 1, 1, 1), (3, 1, 1, 1)], 6, 3, 2, restart)
    ((image, plane),) = media.decode_dc([data])[0]
    assert (image.width, image.height, plane.shape) == (48, 32, (4, 6))
    got = [plane[2 * (u // 3) + b // 2, 2 * (u % 3) + b % 2] for u in range(6) for b in range(4)]
    assert got == [min(max(v * 16 // 8 + 128, 0), 255) for v in levels]


def test_media_refuses_progressive():
    with pytest.raises(ValueError):
        media.parse(b"\xff\xd8\xff\xc2\0\x0b\x08\0\x08\0\x08\1\1\x11\0")


# -- secrets


def b64(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])) + body


KEY = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i]) * 60) for i in range(8)))
SSH = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 9, b"priv" * 9))
TOKEN = f"{b64({'alg': 'HS256'})}.{b64({'sub': 1})}.sig_-1"
SAMPLES = {
    f"see {TOKEN} there": "jwt:4:44",
    f"{b64({'typ': 'JWT'})}.{b64({'sub': 1})}.sig": "",
    "k " + base64.b64encode(KEY).decode(): f"der:2:{2 + len(base64.b64encode(KEY))}",
    "k " + base64.b64encode(KEY[:-1]).decode(): "",
    "k " + KEY.hex().upper(): f"der:2:{2 + 2 * len(KEY)}",
    "s " + base64.b64encode(SSH).decode(): f"ssh:2:{2 + len(base64.b64encode(SSH))}",
    "s " + base64.b64encode(SSH[:-3]).decode(): "",
    "A" * 300: "",
}
BASE = [
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def test_secret_structures(frame):
    own = lambda spans: ",".join(s for s in spans.split(",") if s.split(":")[0] in ("jwt", "der", "ssh"))
    got = {r.doc_id: own(r.spans) for r in secrets.digest(secrets.secret_spans(frame(list(enumerate(SAMPLES))))).collect()}
    assert [got[i] for i in range(len(SAMPLES))] == [v.replace(":44", f":{4 + len(TOKEN)}") for v in SAMPLES.values()]


def test_secret_base_spans(frame, tricky, small_docs, none):
    extra = ['PASSWORD = "abcdef"', "ſecret=abcdefgh", "token:short", "é" * 9 + "AKIA" + "B" * 16 + "token=x" + "a" * 24, "api_key='" + "f" * 40 + "'", "my.apikey: a.b.c.d.e-f", "a" * 100_000]
    rows = tricky + [(1000 + i, x) for i, x in enumerate(extra)] + [(2000 + r.doc_id, r.text) for r in small_docs.collect()]
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.secret_spans(frame(rows))).collect())
    expected = Counter()
    for i, t in text_rows(rows):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, t) if ok(m))
        counts = Counter(s[2] for s in spans)
        digest = hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest()
        expected[i, counts["assign"], counts["access"], counts["hex"], digest] += 1
    assert got == expected
    assert secrets.digest(secrets.secret_spans(none)).count() == 0


def test_redaction(frame):
    df = frame([(1, "a password=abcdefgh b"), (2, None), (3, "clean")])
    rows = {r.doc_id: r for r in secrets.redacted_rows(df).collect()}
    assert (rows[1].text, rows[2].text, rows[3].text) == ("a [secret] b", None, "clean") and rows[1].asDict().keys() == set(df.columns)


# -- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


PERSONAL = [
    "x@y.zz%q@r.st.", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567 x 4111 1111 1111 1111", "😀 a@b.co 4111111111111111-", ".@a.b" + ".c" * 600 + "@d.e", "0000000001.2.3.004", "1.2.3.99999999999999999999",
    "12  34 - 5", "a." * 3000 + "@", "1 2 3 " * 20_000, "1-2 " * 9, "a" * 50_000, "+" * 500 + "1.2" * 200, "4111 1111-1111 1111 5500005555555559", "a@b", "a@b.c@d.e",
]


def test_personal_data(frame, tricky, small_docs, none):
    rows = tricky + [(1000 + i, x) for i, x in enumerate(PERSONAL)] + [(2000 + r.doc_id, r.text) for r in small_docs.collect()]
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.spans(frame(rows))).collect())
    expected = Counter()
    for i, t in text_rows(rows):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if holds(name, m[0]))
        counts = Counter(s[2] for s in spans)
        expected[i, *(counts[n] for n in PATTERNS), hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in spans).encode()).hexdigest()] += 1
    assert got == expected
    assert pii.digest(pii.spans(none)).count() == 0


def test_accounts_and_context(frame):
    rows = {r.doc_id: r for r in pii.digest(pii.spans(frame([(1, "bank account GB82 WEST 1234 5698 7654 32 ."), (2, "GB83WEST12345698765432"), (3, "call +1 555 123 4567"), (4, "xx +1 555 123 4567")]))).collect()}
    assert rows[1].spans == "iban:13:40" and rows[2].spans == ""
    assert float(rows[3].scores) > float(rows[4].scores)


def test_personal_data_is_native(docs):
    plan = pii.digest(pii.spans(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# -- pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


BITS = ["the", "in", "er", " ", "  ", "a", "b", "ing", "▁", "\n", "é", "☃", "1", ".", ",", " t", "ha", "ation", "日本", "<s>", "\0", "<0x0A>"]


@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from(BITS), max_size=60).map("".join), chunk=st.sampled_from([17, 23, 64, 200]))
def test_pieces_like_the_library(text, chunk):
    expected = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    assert pieces.encode(text, PIECES).tolist() == expected
    assert pieces.encode(text, PIECES, chunk).tolist() == expected
    if "▁" not in text:
        assert pieces.pieces_of(PIECES).decode(np.array(expected, int)).decode() == text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=3, max_size=9), st.randoms())
def test_products_of_transfer_matrices_are_associative(sizes, rnd):
    m = [np.array([[rnd.choice([0.0, -np.inf, float(rnd.randint(-9, 9))]) for _ in range(b)] for _ in range(a)]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
    left = m[0]
    for i, x in enumerate(m[1:], 1):
        left = pieces.compose(left, x)
        assert (pieces.prefixes(m, pieces.compose)[i] == left).all()


def test_pieces_of_giant_texts(frame, tricky, model, monkeypatch, none):
    monkeypatch.setattr(pieces, "GIANT", 1500)
    monkeypatch.setattr(pieces, "CHUNK", 600)
    monkeypatch.setattr(pieces, "BLOCK", 3)
    got = Counter((r.doc_id, r.n_chars, r.n_ids, r.ids_crc32, r.decoded_sha256) for r in pieces.encoded(frame(tricky), PIECES).collect())
    expected = Counter()
    for i, t in text_rows(tricky):
        ids = np.array(model.encode(t), "<i4")
        expected[i, len(t), len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == expected
    assert pieces.encoded(none, PIECES).count() == 0
