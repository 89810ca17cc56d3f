"""Periodic runs against a search of every period, and the query against plain Python."""

import hashlib
import random

import numpy as np
import pytest

from brevia.llm import periodicity
from brevia.llm.periodicity import Runs, collapsed, periodic_runs, planted, word_runs
from brevia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    best = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q):
                best.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted((*place, q) for place, q in best.items())


def texts(seed):
    draw = random.Random(seed)
    letters = draw.choice([1, 2, 2, 3, 5])
    words = [draw.randrange(letters) for _ in range(draw.randint(0, 130))]
    for _ in range(draw.randint(0, 4)):
        cycle = [draw.randrange(letters) for _ in range(draw.randint(1, 25))]
        at = draw.randint(0, len(words))
        words[at:at] = (cycle * draw.randint(2, 8))[:draw.randint(1, 200)]
    return words, draw


@pytest.mark.parametrize("seed", range(200))
def test_runs_equal_search_of_every_period(seed):
    words, draw = texts(seed)
    expected = brute(words)
    assert word_runs([b"%d" % w for w in words]) == expected
    runs, at = Runs(), 0
    while at < len(words):  # appended bit by bit
        size = draw.randint(1, draw.choice([1, 3, 40]))
        runs.append(np.array(words[at:at + size], np.int64))
        at += size
    assert runs.found() == expected


def test_runs_are_known_as_soon_as_they_have_four_periods():
    runs = Runs()
    for n, word in enumerate([7, 8, 1, 2, 3] + [4, 5, 6] * 4, 1):
        runs.append(np.array([word], np.int64))
        assert runs.found() == ([(5, 12, 3)] if n == 17 else [])


@pytest.mark.parametrize("cycle", [1, 2, 3, 7, 64, 1000])
def test_long_periodic_text(cycle):
    words = [b"w%d" % (k % cycle) for k in range(100_000)]
    assert word_runs(words) == [(0, 100_000, cycle)]
    assert collapsed(words, word_runs(words)) == words[:cycle]


def test_many_short_runs():
    words = ([b"a"] * 6 + [b"b"]) * 3 + [b"c"] + ([b"x"] * 7 + [b"y", b"z"]) * 2
    assert word_runs(words) == brute(words)


def test_equal_hashes_of_unequal_words(monkeypatch):
    monkeypatch.setattr(periodicity, "ODD", np.uint64(0))  # all windows seem equal
    for seed in range(20):
        words, _ = texts(seed)
        known = {(s, n) for s, n, _ in brute(words)}
        for start, length, q in word_runs([b"%d" % w for w in words]):
            assert words[start:start + length - q] == words[start + q:start + length]
            assert (start, length) in known


def test_odd_documents(spark, make_docs, odd_rows):
    docs = make_docs([*odd_rows, (1, "a b " * 4), (1, "a b " * 4)], True)
    found = {r["doc_id"]: r for r in periodic_runs(docs).collect()}
    assert periodic_runs(docs).count() == len(odd_rows) + 2
    assert [tuple(r) for r in found[905]["runs"]] == [(0, 30_000, 1)]
    assert found[905]["collapsed"] == "long"
    for key in (900, 901, 902, 903, None):
        assert found[key]["runs"] == []
    assert found[900]["collapsed"] == "" and found[903]["n_words"] == 1
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 8, 2)]
    assert periodic_runs(docs.filter("false")).count() == 0


def test_query_equals_plain_python(spark):
    found = {r["doc_id"]: r for r in QUERIES["op11_dyadic_square_catching"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        words = planted(row["doc_id"], (row["text"] or "").encode().split())
        runs, got = brute(words), found[row["doc_id"]]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (got["start"], got["length"], got["period"]) == top
        assert got["n_runs"] == len(runs)
        assert got["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        assert got["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
