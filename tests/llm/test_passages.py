import hashlib
import random

import numpy as np

from brevia.llm.passages import phrases_of, remove_passages, sampled_at, settled
from brevia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    first = {}
    for key, text in rows:
        w = (text or "").encode().split()
        for s in range(len(w) - window + 1):
            run = tuple(w[s:s + window])
            first[run] = min(key, first.get(run, key))
    out = []
    for key, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < key:
                gone[s:s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, **options):
    cut, rest = remove_passages(docs, **options)
    rows = [(r["id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest())
            for r in cut.collect()]
    return sorted(rows + [tuple(r) for r in rest.select(
        "id", "n_words", "n_removed", "kept_sha256").collect()], key=lambda r: (r[0] is None, r))


def test_equals_all_windows(make_docs, words, odd_rows):
    draw = random.Random(1)
    shared = [words(n, 50 + n) for n in (49, 50, 51, 80, 200)]
    rows = []
    for key in range(60):
        parts = [words(draw.randint(0, 120), 1000 + key)]
        for passage in draw.sample(shared, 2):
            at = draw.randint(0, 5)
            parts += [passage[at:], words(draw.randint(0, 9), 2000 + key)]
        rows.append((draw.randint(0, 10**6), "  ".join(w for p in parts for w in p)))
    rows += [(10**7, rows[5][1]), (10**7 + 1, rows[5][1]), rows[7], (rows[8][0], "other " * 60)]
    rows += [(r[0], r[1]) for r in odd_rows if r[0] is not None] + [(906, "long " * 70)]
    got = found(make_docs(rows, True), block_bytes=20_000)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000
    assert found(make_docs(rows)) == got  # in one block


def test_no_id_stays_whole(make_docs, words):
    text = " ".join(words(60, 3))
    got = found(make_docs([(None, text), (5, text), (6, text)]))
    assert [(r[0], r[2]) for r in got] == [(5, 0), (6, 60), (None, 0)]


def test_empty(make_docs):
    assert found(make_docs([])) == []


def test_query_equals_all_windows(spark):
    got = QUERIES["op3_phrase_automata"](spark, SF).select(
        "doc_id", "n_words", "n_removed", "kept_sha256").collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == brute([(r[0], r[1]) for r in rows])


def test_batches_of_a_few_rows(spark, make_docs, words):
    passage, other = words(70, 1), words(55, 2)
    rows = [(key, " ".join(words(key % 7, 100 + key) + (passage if key % 3 else other) + words(3, 500 + key)))
            for key in range(90)] + [(200, " ".join(passage * 3))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(make_docs(rows[::-1]).repartition(4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_settled_windows_have_a_smaller_document():
    draw = random.Random(4)
    rows = sorted(((draw.randint(0, 9), draw.randint(0, 1), draw.randint(0, 20)) for _ in range(300)),
                  key=lambda r: r[2])
    h1, h2, ids = (np.array(c, np.int64) for c in zip(*rows))
    first = {}
    for a, b, key in rows:
        first[a, b] = min(key, first.get((a, b), key))
    real = np.array([key > first[a, b] for a, b, key in rows])
    told = settled(h1, h2.astype(np.int16), ids)
    assert not (told & ~real).any()
    one = np.zeros_like(h2)
    least = {a: min(k for x, _, k in rows if x == a) for a, _, _ in rows}
    assert settled(h1, one, ids).tolist() == [key > least[a] for a, _, key in rows]
    assert settled(h1[:0], h2[:0], ids[:0]).tolist() == []


def test_each_sampled_phrase_has_a_place():
    draw = np.random.default_rng(3)
    for n, kinds in ((50, 9), (51, 3), (400, 40), (3000, 10**9)):
        hashes, chosen = phrases_of(draw.integers(0, kinds, n).astype(np.uint64), 50, 6)
        assert sorted(hashes[sampled_at(hashes, chosen, 45)]) == sorted(set(chosen.tolist()))
