from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, h1 string, m long, key string, found int, own_0 int, vector string"


def words(rnd, n, letters="ghijk"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def tricky():
    """(doc_id, text): nulls, empty and long texts, equal and near copies, repeated ids and rows, shared passages, periodic texts."""
    rnd = random.Random(5)
    base = [words(rnd, n, "abcdefghij") for n in (5, 40, 80, 200, 300, 1, 13, 14)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(None, None), (20, None), (21, ""), (None, base[3]), (30, base[3]), (31, base[3]), (31, base[3]), (32, base[2]), (32, base[4]), (7, base[7])]
    edited = base[4].split()
    edited[100] = "changed"
    rows += [(40, " ".join(edited)), (41, base[4].upper()), (42, base[4].replace(" ", "\n", 30)), (43, "é" * 300 + base[3]), (44, " \t\n")]
    passage = words(rnd, 60, "lmnop")
    rows += [(100 + i, f"{words(rnd, rnd.randint(0, 30))} {passage[rnd.randint(0, 80):]} {words(rnd, rnd.randint(0, 30))}") for i in range(40)]
    rows += [(200 + i, f"head{i} " + "up down " * rnd.randint(10, 60) + f"tail{i}") for i in range(15)]
    rows += [(300, "x" * 3000), (301, "ab " * 4000), (302, "ab " * 4000), (303, "日本語 テキスト  " * 90), (304, "a\0b " * 70), (305, words(rnd, 20_000))]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of (doc_id, text) rows with other columns of awkward names, in several partitions."""

    def make(rows):
        full = [(i, t, "x", 1, "k", None, 2, "v") for i, t in rows]
        df = spark.createDataFrame(full, COLUMNS)
        return df.repartition(4) if rows else df

    return make


@pytest.fixture(scope="session")
def docs(frame, tricky):
    return frame(tricky)


@pytest.fixture(scope="session")
def none(frame):
    return frame([])


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
