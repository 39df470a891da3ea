"""Packing, toxicity and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import neardup, packing, secrets, substrings, toxicity
from tidemark.llm.durable import stored
from tidemark.llm.durable import cut
from tidemark.llm.tokens import WordIds

WORDS = public_tokenizers.path("word_bpe_49k.json")


def fits(pieces, limit):
    """No gap, no overlap, nothing over the limit; the number of sequences."""
    rooms = defaultdict(list)
    for sequence, offset, length in pieces:
        rooms[sequence].append((offset, length))
    for items in rooms.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= limit
    return len(rooms)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=400))
def test_plans(limit, sizes):
    counts = Counter(min(s, limit) for s in sizes)
    rows, bins = packing.plan(counts, limit)
    ranks, pieces = defaultdict(list), []
    for size, first, n, per, at, offset in rows:
        ranks[size] += range(first, first + n)
        pieces += [(at + j // per, offset + j % per * size, size) for j in range(n)]
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert fits(pieces, limit) == bins and len(rows) <= packing.max_plan_rows(limit)
    least = -(-sum(s * n for s, n in counts.items()) // limit)
    assert bins <= 1.25 * least + 1


def test_large_pieces_pair_best():
    assert packing.plan({60: 2, 40: 2, 35: 1}, 100)[1] == 3
    assert packing.plan({50: 3, 34: 2, 66: 2}, 100)[1] == 4


@pytest.mark.parametrize("limit", [16, 4096])
def test_packing(spark, docs, tricky, none, limit):
    got = packing.pack(spark, cut(packing.pieces(docs, WORDS, limit)), limit).collect()
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in tricky:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), limit)):
            part = ids[a : a + limit]
            expected[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    used = fits([(r.sequence_id, r.offset, r.length) for r in got], limit)
    assert used <= 1.05 * -(-sum(r.length for r in got) // limit) + 1
    assert packing.pack(spark, cut(packing.pieces(none, WORDS, limit)), limit).count() == 0


def test_sequences_with_ids(docs):
    rows = packing.pieces(docs, WORDS, 64, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["the", "Word", ".", ",", " ", "  ", "'s", "é", "É", "İ", "ΑΣ", "<|endoftext|>", "<|", "<|ENDOFTEXT|>", "\x1c", " ", "9", "日本", "ß", "-", "|>", "%%%", "!", "'", "`~", "\n", "\0", "ﬁ"]), max_size=30).map("".join))
def test_word_ids_like_the_library(text):
    ids = WordIds(WORDS)
    for _ in range(2):
        assert np.frombuffer(ids.text_ids(pa.array(["x", text, "y <| z", text]))[1], "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


def test_words_are_met_once_whatever_signs_follow():
    texts = ["Word, word. word; (word) word!?", "word's çé, çé. ÇÉ... é' é.'x é\u0301, a.b,c-d x_y z", "ﬁ, ΑΣ. İ! 9,5 ß[1]"]
    ids = WordIds(WORDS)
    got = [np.frombuffer(x, "<u4").tolist() for x in ids.text_ids(pa.array(texts))]
    assert got == [Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids for t in texts]
    assert {w for w in ids if b"word" in w} == {b"word", b"(word", b"word's"} and "çé,".encode() not in ids


# -- toxicity


def labelled(spark, n=600):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 60))]
        toxic = rnd.random() < 0.3
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["zorkle", "zorkles", "zorked", "vlunt"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, frame):
    rows, labels, table = labelled(spark)
    df = frame([*rows, (None, None), (None, "you idiot"), (5, rows[5][1]), (10_000, "")])
    got = toxicity.score(df, toxicity.fit(df, table)).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    truth = dict(labels)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    kept = toxicity.unrejected_rows(df, toxicity.fit(df, table))
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in got)


def test_held_out_labels_are_never_read(spark, frame):
    rows, labels, table = labelled(spark, 300)
    df = frame(rows)
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id long, toxic int")
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(df, toxicity.fit(df, t)).collect()) for t in (table, flipped))
    assert one == two


def test_without_labels(spark, frame, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.score(frame([(1, "what an idiot"), (2, "fine")]), toxicity.fit(frame([(1, "x")]), empty)).collect()}
    assert scores == {1: 1, 2: 0}
    assert toxicity.score(none, toxicity.fit(none, empty)).count() == 0


def counted(votes):
    """Sets of votes and how many rows have each."""
    sets, counts = np.unique(votes, axis=0, return_counts=True)
    return sets.astype(float), counts.astype(float)


def test_label_model_estimates_planted_voters_without_labels():
    rnd = np.random.default_rng(0)
    n, on_one, on_zero = 60_000, [0.6, 0.5, 0.7, 0.4], [0.02, 0.01, 0.05, 0.03]
    y = rnd.random(n) < 0.2
    votes = np.stack([np.where(y, rnd.random(n) < a, rnd.random(n) < b) for a, b in zip(on_one, on_zero, strict=True)], 1)
    echo = np.where(rnd.random(n) < 0.9, votes[:, 0], np.where(y, rnd.random(n) < 0.6, rnd.random(n) < 0.02))
    found = toxicity.label_model(*counted(np.column_stack([votes, echo])))
    assert abs(found.prior - 0.2) < 0.04
    assert np.allclose(found.on_one[:4], on_one, atol=0.1) and np.allclose(found.on_zero[:4], on_zero, atol=0.03)
    assert found.related[0, 4] > 0.7 and found.related[1, 2] < 0.15 and found.related[0, 1] < 0.15
    sets, counts = counted(np.column_stack([votes, y]))
    q = toxicity.label_model(sets[:, :4], counts).posterior
    assert (((q > 0.5) == (sets[:, 4] > 0)) * counts).sum() / n > 0.93


def test_the_training_rows_are_the_same_each_time(spark, monkeypatch):
    """Equal texts with other labels count as the largest; repeated ids keep to the bound."""
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"text {k % 7}") for k, i in enumerate(ids)] + [(ids[0], f"other {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] + [(ids[1], 0), (None, 1), (ids[2], None)], "doc_id long, toxic int")
    want = {}
    truth = {i: k % 2 for k, i in enumerate(ids)}
    for i, t in rows:
        want[t] = max(want.get(t, 0), truth[i])
    assert {(r.text, r.toxic) for r in toxicity.training_rows(docs, labels).collect()} == set(want.items())
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 30)
    few = [sorted(map(tuple, toxicity.training_rows(docs.repartition(n), labels).collect())) for n in (1, 7)]
    assert few[0] == few[1] and len(few[0]) <= 30


def test_sets_of_votes_beyond_the_bound_stand_for_the_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PATTERN_ROWS", 6)
    patterns = spark.createDataFrame([([], 1000)] + [([i], 10) for i in range(10)], "hits array<int>, n long")
    votes, counts = toxicity.votes_of(patterns, 10)
    assert len(counts) == 6 and counts.sum() == 1100 and counts[votes.sum(1) == 0] == [1000]


# -- the pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {i: r.text for i, r in rows.items() if model.score(r.text) < 0.7}
    sets = {i: set(neardup.shingle_set(t.encode(), 5).tolist()) for i, t in rows.items()}
    groups = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if b < a and (not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((groups[a], groups[b]))
                groups = {i: x if g == y else g for i, g in groups.items()}
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    first = {}
    for i in sorted(rows):
        w = rows[i].encode().split()
        for a in range(len(w) - 12):
            first.setdefault(tuple(w[a : a + 13]), i)
    for i, t in rows.items():
        w = t.encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < i:
                gone[a : a + 13] = [True] * 13
        if any(gone):
            rows[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    library = Tokenizer.from_file(WORDS)
    expected = Counter()
    for i, t in rows.items():
        ids = np.array([*library.encode(secrets.redact(t), add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            expected[i, k, a, zlib.crc32(ids[a : a + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == expected
    fits([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "secret_scans", "best_fit_packing"]
    assert substrings.WINDOW == 13


def test_stages_return_the_columns_of_documents(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0


def test_pipeline_on_nulls_empty_and_long_texts_and_repeats(spark, docs, tricky):
    """Each stage on awkward rows: its columns stay, its decisions hold, and what is left is packed whole."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    rows, kinds = docs, docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows.select("doc_id", "text").collect()
        rows = stored(stage(spark, rows, sf_dir))
        after = rows.select("doc_id", "text").collect()
        assert rows.dtypes == kinds and len(after) <= len(before)
        if name == "simhash_near_dedup":
            texts = {r.text or "" for r in before}
            assert len({r.text or "" for r in after}) == len(after) and {r.text or "" for r in after} <= texts
        if name in ("substring_dedup", "secret_scans"):
            assert sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted((r.doc_id is None, r.doc_id or 0) for r in before)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
    library = Tokenizer.from_file(WORDS)
    assert sum(r.length for r in packed) == sum(1 + len(library.encode(r.text or "", add_special_tokens=False).ids) for r in after)
    fits([(r.sequence_id, r.offset, r.length) for r in packed], 4096)
