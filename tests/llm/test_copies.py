"""Operators that compare rows with one another, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import embeddings, neardup, simhash, substrings, suffixes, windows
from tidemark.llm.components import components

LAST = (1 << 63) - 1


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(-5, -9), (7, 7), (200, 200), (140, 139), (140, 139)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 141)} | {-5: -9, -9: -9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(docs, tricky, none):
    rows = [(i, t or "") for i, t in tricky]
    fps = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    names = defaultdict(list)
    for r, (i, _) in zip(root, rows, strict=True):
        names[r] += [i] if i is not None else []
    expected = Counter((i, f, min(names[r], default=None)) for (i, _), f, r in zip(rows, fps, root, strict=True))
    got = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == expected
    assert simhash.simhash_components(none).count() == 0


def test_simhash_links_by_balls(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 3, base ^ 0xC0000000, base ^ 0xFC0000000, -1, 0, 1 << 63]
    links = simhash.links(spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long"))
    assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    tied = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(links).collect()}
    assert tied[base] == tied[base ^ 3] == tied[base ^ 0xC0000000] and tied[0] == tied[1 << 63] and (base ^ 0xFC0000000) not in tied


# -- near copies


def shingles(t):
    w = t.encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies(docs, tricky, none):
    texts = sorted({t or "" for _, t in tricky})
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: not (a | b) or len(a & b) >= 0.8 * len(a | b)
    root = dict(zip(texts, roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])]), strict=True))
    least = {}
    for i, t in tricky:
        key = LAST if i is None else i
        least[root[t or ""]] = min(least.get(root[t or ""], LAST), key)
    kept = neardup.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(LAST if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(least.values())
    assert neardup.one_of_each_group(none).count() == 0


def test_near_copies_are_found(spark):
    rnd = np.random.default_rng(1)
    words = lambda n: [f"w{x}" for x in rnd.integers(0, 50_000, n)]
    rows, copies = [], 0
    for i in range(150):
        text = words(300)
        rows.append((2 * i, " ".join(text)))
        text[int(rnd.integers(5, 295))] = "other"
        for k in range(int(rnd.integers(0, 5))):
            text[(17 + 60 * k) % 300] = f"changed{k}"
        if len(shingles(rows[-1][1]) & shingles(" ".join(text))) >= 0.8 * len(shingles(rows[-1][1]) | shingles(" ".join(text))):
            copies += 1
        rows.append((2 * i + 1, " ".join(text)))
    kept = neardup.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r.doc_id for r in kept.collect()}
    assert all(2 * i in ids for i in range(150)) and 300 - len(ids) >= copies


def kept_by_brute_force(texts):
    """Numbers of the texts that stay: the least of each component."""
    sets = [shingles(t) for t in texts]
    number = {}
    held = [[number.setdefault(x, len(number)) for x in s] for s in sets]
    flags = np.zeros((len(sets), len(number)), np.float32)
    for i, h in enumerate(held):
        flags[i, h] = 1
    common, n = flags @ flags.T, flags.sum(1)
    pairs = np.argwhere(np.triu(common >= 0.8 * (n[:, None] + n[None] - common), 1))
    return {i for i, r in enumerate(roots(len(texts), [(int(b), int(a)) for a, b in pairs])) if i == r}


def kept_texts(spark, texts):
    return {r.doc_id for r in neardup.one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_near_copies_in_a_family_of_similar_texts(spark):
    rnd = np.random.default_rng(3)
    template = [f"t{x}" for x in rnd.integers(0, 50_000, 300)]

    def changed(words, n, name):
        out = list(words)
        for k in rnd.choice(300, n, replace=False):
            out[k] = f"{name}x{k}"
        return out

    family = [changed(template, 5, f"f{i}") for i in range(2000)]
    family += [changed(family[i], 3, f"c{i}") for i in range(0, 2000, 10)]
    texts = [" ".join(family[i]) for i in rnd.permutation(len(family))]
    expected = kept_by_brute_force(texts)
    assert 1000 < len(expected) <= 2000
    assert kept_texts(spark, texts) == expected


def test_texts_of_few_words_are_told_apart_by_shingles(spark):
    rnd = np.random.default_rng(4)
    texts = [" ".join(f"d{x}" for x in rnd.integers(0, 20, 4000)) for _ in range(6)]
    texts += [f"{texts[0]} " + " ".join(f"n{x}" for x in range(500))]
    assert kept_by_brute_force(texts) == set(range(6))
    assert kept_texts(spark, texts) == set(range(6))


def test_near_copies_with_a_section_more_or_less(spark):
    rnd = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rnd.integers(0, 50_000, n)]
    texts = [words(300) for _ in range(150)]
    for i in range(150):
        n, at = int(rnd.integers(45, 70)), int(rnd.integers(10, 200))
        texts.append([texts[i] + words(n), texts[i][: 300 - n * 4 // 5], texts[i][:at] + words(n) + texts[i][at:]][i % 3])
    texts = [" ".join(t) for t in texts]
    expected = kept_by_brute_force(texts)
    assert len(expected) < 200
    assert kept_texts(spark, texts) == expected


# -- repeated bytes and words


def plain_bytes(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[a : a + 200] for _, t in data for a in range(len(t) - 199))
    out = Counter()
    for i, t in data:
        gone, last = bytearray(len(t)), 0
        for a in range(len(t) - 199):
            if seen[t[a : a + 200]] > 1:
                last = max(last, a)
                gone[last : a + 200] = b"\1" * (a + 200 - last)
                last = a + 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def plain_words(rows):
    data = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in data:
        for a in range(len(w) - 12):
            g = tuple(w[a : a + 13])
            first[g] = min(first.get(g, LAST), LAST if i is None else i)
    out = Counter()
    for i, w in data:
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < (LAST if i is None else i):
                gone[a : a + 13] = [True] * 13
        out[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [2, 10, 10**9])
def test_repeated_bytes(docs, tricky, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_TEXTS", hot)
    assert Counter(map(tuple, suffixes.repeated_bytes(docs).collect())) == plain_bytes(tricky)


@pytest.mark.parametrize("hot", [2, 10, 10**9])
def test_repeated_words(docs, tricky, monkeypatch, hot):
    monkeypatch.setattr(windows, "HOT_TEXTS", hot)
    assert Counter(map(tuple, substrings.repeated_passages(docs).collect())) == plain_words(tricky)


def test_repeats_of_the_shared_documents(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert Counter(map(tuple, suffixes.repeated_bytes(small_docs).collect())) == plain_bytes(rows)
    assert Counter(map(tuple, substrings.repeated_passages(small_docs).collect())) == plain_words(rows)


@pytest.mark.parametrize("module", [suffixes, substrings])
def test_the_kernel_decides_repeated_runs(spark, monkeypatch, module):
    """A kernel that finds nothing leaves only what hot anchors and texts' own repeats settle; here there are none."""
    rnd = np.random.default_rng(12)
    word = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10**6, n))
    passages = [word(70) for _ in range(5)]
    rows = [(i, f"{word(30)} {passages[i % 5]} {word(30)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(windows, "HOT_TEXTS", 10**9)
    run, plain = (suffixes.repeated_bytes, plain_bytes) if module is suffixes else (substrings.repeated_passages, plain_words)
    assert Counter(map(tuple, run(docs).collect())) == plain(rows)
    monkeypatch.setattr(module, "kernel_of", lambda window: lambda contents, group, m, count, at: np.zeros(int(count.sum()), bool))
    gone = {r.doc_id: r.n_removed for r in run(docs).collect()}
    assert sum(n == 0 for n in gone.values()) >= 10


def test_texts_of_several_blocks(spark, monkeypatch):
    """Repeats across and beyond the blocks in which a long text is handled."""
    monkeypatch.setattr(windows, "BLOCK", 300)
    rnd = np.random.default_rng(13)
    word = lambda n: " ".join(f"w{x}" for x in rnd.integers(0, 10**5, n))
    passage = word(400)
    rows = [(1, f"{word(500)} {passage} {word(700)}"), (2, f"{word(250)} {passage} {word(30)}"), (3, word(1500)), (4, f"{passage} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, suffixes.repeated_bytes(docs).collect())) == plain_bytes(rows)
    assert Counter(map(tuple, substrings.repeated_passages(docs).collect())) == plain_words(rows)


def test_rows_of_runs_do_not_depend_on_the_order_of_texts(spark):
    rnd = np.random.default_rng(14)
    passage = " ".join(f"w{x}" for x in rnd.integers(0, 10**5, 60))
    rows = [(i, i, 1, f"head{i} {passage} tail{i}") for i in range(50)]
    shape = substrings.shape_of()
    found = []
    for order in (rows, rows[::-1]):
        texts = windows.compressed(spark.createDataFrame(order, "m long, t long, n long, text string").coalesce(1))
        found.append(sorted(map(tuple, windows.anchors(texts, shape, np.empty(0, np.uint64)).collect())))
    assert found[0] == found[1]


def test_no_rows(none):
    assert suffixes.repeated_bytes(none).count() == 0 and substrings.repeated_passages(none).count() == 0 and substrings.without_repeated(none).count() == 0


def test_texts_without_repeated_passages(docs, tricky):
    kept = substrings.without_repeated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    removed = Counter((k[0], k[3]) for k in plain_words(tricky).elements())
    assert Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got) == removed
    assert sum(r.text is None for r in got) == sum(t is None for _, t in tricky)


def test_radix_groups():
    data = np.frombuffer(b"abcdefghijkl" * 3 + b"abcdefghijkX", np.uint8)
    place = np.arange(0, 36)
    found = suffixes.radix_groups(np.zeros(36, np.int64), place, data, 12)
    texts = [data[p : p + 12].tobytes() for p in place]
    assert found.tolist() == [texts.count(t) > 1 for t in texts]


# -- vectors


def plain_links(rows):
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = [0] * len(rows), []
    for a in ok:
        for b in ok:
            if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    root = roots(len(rows), links)
    names = defaultdict(list)
    for r, (i, _, _) in zip(root, rows, strict=True):
        names[r] += [i] if i is not None else []
    return n, [min(names[r], default=None) for r in root]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 40)
    rnd = np.random.default_rng(0)
    base = rnd.normal(size=(120, 32))
    noisy = base + rnd.normal(size=base.shape) * 0.25
    rows = [(i, v.tolist(), i % 120 % 2) for i, v in enumerate(np.concatenate([base, noisy]))]
    cluster = rnd.normal(size=32)
    rows += [(1000 + i, (cluster + rnd.normal(size=32) * 0.1).tolist(), 1) for i in range(150)] + [(1500 + i, cluster.tolist(), 1) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 32, 1), (2002, [float("nan")] * 32, 1), (2003, [1.0] * 3, 1), (2004, [1.0] * 3, 1), (2005, cluster.tolist(), None), (None, base[0].tolist(), 0)]
    rows += [(2006, [], 0), (2007, base[0].tolist(), 0), (2007, base[0].tolist(), 0), (2008, [1e300] * 32, 0), (2009, [1e-300] * 32, 0), (2010, [None] * 32, 0)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    n, names = plain_links(rows)
    found = {r.vec_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(found[i].n_links <= k for (i, _, _), k in zip(rows, n, strict=True))
    assert sum(found[i].n_links for i, _, _ in rows) >= 0.95 * sum(n)
    exact = [(i, k, name) for (i, _, _), k, name in zip(rows, n, names, strict=True) if i is None or i >= 1000]
    assert sum((found[i].n_links, found[i].component_id) == (k, name) for i, k, name in exact) >= 0.95 * len(exact)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found.values())
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("partitions", [1, 12])
def test_vectors_of_mixed_lengths(spark, partitions):
    """Links of rare lengths are exact, whatever the partitions; those of common lengths too at so few pivots."""
    rnd = np.random.default_rng(6)
    rows = []
    for size, n in ((16, 200), (3, 4), (2, 3), (32, 90), (5, 10)):
        base = rnd.normal(size=(n, size))
        rows += [(len(rows) + i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([base, base + rnd.normal(size=base.shape) * 0.05]))]
    rows += [(5000 + i, [1.0, 1.0, 1.0 + i / 1000], 0) for i in range(4)]
    n, names = plain_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(partitions)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert sum(n) > 300 and found == {i: (k, name) for (i, _, _), k, name in zip(rows, n, names, strict=True)}


def test_long_lists_are_dealt_by_second_pivots(spark, monkeypatch):
    """The same links whether lists are long or short."""
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(12, 24))
    data = np.concatenate([b + rnd.normal(size=(60, 24)) * 0.35 for b in base])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], "vec_id long, embedding array<float>, label int")
    whole = sorted(embeddings.near_vectors(df).collect())
    monkeypatch.setattr(embeddings, "TILE", 5)
    assert sorted(embeddings.near_vectors(df).collect()) == whole and sum(r.n_links for r in whole) > 500


def test_shared_counts():
    near = np.array([[1, 2, 3], [3, 2, 9], [7, 8, 9], [1, 2, 3]], np.int32)
    assert np.triu(embeddings.shared_counts(near), 1).tolist() == [[0, 2, 0, 3], [0, 0, 1, 2], [0, 0, 0, 0], [0, 0, 0, 0]]


@pytest.mark.parametrize(("rows", "pivots"), [(2000, 32), (8000, 512), (8000, 4096)])
def test_recall_at_several_numbers_of_pivots(spark, monkeypatch, rows, pivots):
    """Planted pairs of cosines from 0.931 to 0.97."""
    monkeypatch.setattr(embeddings, "MIN_PIVOTS", pivots)
    rnd = np.random.default_rng(9)
    one = embeddings.unit(rnd.normal(size=(rows // 2, 64)))
    side = rnd.normal(size=one.shape)
    side = embeddings.unit(side - (side * one).sum(1, keepdims=True) * one)
    cosine = rnd.uniform(0.931, 0.97, (rows // 2, 1))
    two = cosine * one + np.sqrt(1 - cosine**2) * side
    data = np.concatenate([one, two])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in embeddings.near_vectors(df).collect())
    assert 0.95 * rows <= found <= rows


def test_recall_on_the_shared_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    units = np.array([r[1] for r in rows], float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    labels = np.array([-1 if r[2] is None else r[2] for r in rows])
    true = ((units @ units.T >= 0.93) & (labels[:, None] == labels[None])).sum(1) - 1
    found = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert sum(found.values()) >= 0.9 * true.sum() and all(found[r[0]] <= t for r, t in zip(rows, true, strict=True))
