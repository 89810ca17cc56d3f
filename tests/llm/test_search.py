"""Ranked search against a plain version that scores every document by itself."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brevia.llm import search as lexical
from brevia.llm.search import search, terms

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    bags = [(key, Counter(plain_terms(text))) for key, text in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        if text is None:
            continue
        found = []
        for (key, bag), size in zip(bags, sizes):
            m = 25 + (75 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in plain_terms(text) if bag[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -score)
                for rank, (score, _, _, key) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def make_items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id BIGINT, text STRING, doc_id INT, m INT")


def test_terms():
    text = "Ünïcode-Wörd ÀB aB9_c\x00d [x] ｗｉｄｅ 𝒳y~\x7f é f"
    assert [t.decode() for t in terms(text)] == plain_terms(text)
    assert terms(None) == terms(" .!\n") == []


@pytest.mark.parametrize("seed", range(4))
def test_equals_scoring_every_document(spark, make_docs, make_items, odd_rows, seed, monkeypatch):
    monkeypatch.setattr(lexical, "GAINS_AT_ONCE", 7)
    draw = random.Random(seed)
    letters = [f"w{k}" for k in range(40)]

    def text(n):
        return " ".join(draw.choices(letters, weights=range(40, 0, -1), k=n))

    texts = [text(draw.randint(0, 30)) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(draw.choices(texts, k=150))]
    docs += [(1000 + k, "w1 w2 w3 same bag") for k in range(50)] + [(2000, "w1 w1"), (2000, "w1 w1")]
    docs += [(None, "w3 w39 nobody"), *odd_rows]
    items = [(k, text(draw.randint(1, 12)), 1, 2) for k in range(12)]
    items += [(50, None, 1, 2), (51, "", 1, 2), (52, "unheard", 1, 2), (53, "SAME bag bag", 1, 2),
              (53, "SAME bag bag", 1, 2), (54, "nobody long É ß", 1, 2)]
    found = search(make_docs(docs, True).repartition(5), make_items(items), block_bytes=150)
    assert rows_of(found) == brute(docs, [i[:2] for i in items])


def test_unequal_bags_with_one_hash(spark, make_docs, make_items, monkeypatch):
    plain = lexical.same_bag

    def weak(*args):
        _, *rest = plain(*args)
        return [F.lit(7).cast("long").alias("bag_hash"), *rest]

    monkeypatch.setattr(lexical, "same_bag", weak)
    docs = [(k, f"a b {'c ' * (k % 3)} x{k % 7}") for k in range(80)]
    items = [(1, "a c", 0, 0), (2, "b x3", 0, 0)]
    assert rows_of(search(make_docs(docs), make_items(items))) == brute(docs, [i[:2] for i in items])


def test_empty_tables(spark, make_docs, make_items):
    docs, items = make_docs([(1, "a")], True), make_items([(1, "a", 0, 0)])
    assert search(docs.filter("false"), items).count() == 0
    assert search(docs, items.filter("false")).count() == 0
    assert search(make_docs([(1, None), (2, " ")]), items).count() == 0


def test_top_and_types(spark, make_docs):
    docs = make_docs([(k, "a b") for k in range(30)])
    items = spark.createDataFrame([("x", "a"), ("y", "b q")], "name STRING, body STRING")
    found = search(docs, items, item_key="name", item_text="body", top=3)
    assert [r["doc_id"] for r in found.filter("item_id = 'y'").orderBy("rank").collect()] == [0, 1, 2]
