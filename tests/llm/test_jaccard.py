import random

import numpy as np
import pytest

from brevia.llm import jaccard
from brevia.llm.jaccard import BANDS, Likeness, jaccard_components, piece_keys
from brevia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, size, num, den):
    """Smallest id reachable and number of shingles of each id, by all pairs."""
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        k = min(size, len(w)) or 1
        sets.setdefault(key, []).append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)))
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if any(x and y and den * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (root(k), sorted(len(s) for s in sets[k])) for k in keys}


def edited(words, share, draw):
    return [draw.choice(words) if draw.random() < share else w for w in words]


@pytest.mark.parametrize("size,num,den", [(3, 9, 10), (5, 4, 5)])
def test_equals_all_pairs(make_docs, words, odd_rows, size, num, den):
    draw = random.Random(size)
    rows = []
    for base in range(12):
        text = words(draw.choice([4, 8, 12, 20, 60, 150, 400]), base)
        for copy in range(draw.randint(1, 9)):
            share = draw.choice([0, 0.003, 0.01, 0.03, 0.06])
            rows.append((len(rows), " ".join(edited(text, share, draw)).upper()))
    rows += [(r[0], r[1]) for r in odd_rows if r[0] is not None] + [(3, rows[3][1])]
    truth = brute(rows, size, num, den)
    found = jaccard_components(make_docs([*rows, (None, "no id"), (None, rows[0][1])], True),
                               Likeness(size, num, den)).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r["id"] is None:
            assert r["component_id"] is None and r["n_links"] == 0
        else:
            assert (r["component_id"], [r["n_shingles"]]) == (truth[r["id"]][0], truth[r["id"]][1][:1])


def test_many_near_copies_of_each_other(make_docs, words):
    """A chain of copies, each one edit from the last, and a large group of near copies."""
    draw = random.Random(5)
    text = words(300, 77)
    rows = []
    for k in range(120):
        changed = list(text)
        changed[draw.randrange(300)] = f"new{k}"
        rows.append((1000 + k, " ".join(changed)))
    chain = words(200, 78)
    for k in range(25):
        chain[k * 7] = f"step{k}"
        rows.append((2000 + k, " ".join(chain)))
    truth = brute(rows, 3, 9, 10)
    found = jaccard_components(make_docs(rows), Likeness(3, 9, 10)).collect()
    assert {r["id"]: r["component_id"] for r in found} == {k: v[0] for k, v in truth.items()}
    assert len({v[0] for v in truth.values()}) < 10


def test_one_id_with_two_texts(make_docs, words):
    one, two = " ".join(words(40, 1)), " ".join(words(40, 2))
    found = jaccard_components(make_docs([(1, one), (7, one), (7, two), (9, two)])).collect()
    assert {r["component_id"] for r in found} == {1}


def test_empty(make_docs):
    assert jaccard_components(make_docs([])).count() == 0
    assert [r["component_id"] for r in jaccard_components(make_docs([(4, None)])).collect()] == [4]


@pytest.mark.parametrize("like", [Likeness(3, 9, 10), Likeness(5, 4, 5)])
def test_pairs_within_the_bound_share_a_key(like):
    draw = np.random.default_rng(3)
    for _ in range(400):
        size = int(draw.integers(4, 700))
        big = draw.integers(0, 2**63, size * 2, dtype=np.uint64)
        a = np.unique(big[:size])
        drop = int(draw.integers(0, max(1, size // 4)))
        b = np.unique(np.concatenate([a[drop:], big[size:size + int(draw.integers(0, drop + 1))]]))
        if like.linked(a, b) and len(a) != len(np.intersect1d(a, b)):
            assert len(np.intersect1d(piece_keys(a, like), piece_keys(b, like)))
    assert BANDS[0] < BANDS[1]


def test_query_equals_all_pairs(spark):
    found = QUERIES["op7_parity_sketch_join"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    truth = brute([(r[0], r[1]) for r in rows], 3, 9, 10)
    assert {r["doc_id"]: (r["component_id"], [r["n_shingles"]]) for r in found} == truth


def test_long_sketches_rule_out_no_linked_pair(spark):
    draw, like = np.random.default_rng(3), jaccard.Likeness(5, 4, 5)
    rows, linked = [], []
    for n in (500, 520, 700, 1020, 1030, 2047, 2500, 9000):
        for share in (0.0, 0.05, 0.1, 0.111, 0.3, 1.0):
            one = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            kept = one[int(share * len(one)):]
            for other in (kept, np.unique(np.append(kept, draw.integers(0, 2**63, int(share * n))
                                                    .astype(np.uint64)))):
                if not len(other):
                    continue
                sketches = [None if s is None else s.tolist() for s in map(jaccard.long_sketch, (one, other))]
                rows.append((len(rows), len(one), len(other), *sketches))
                linked.append(like.linked(one, other))
    df = spark.createDataFrame(
        rows, "k INT, n_a BIGINT, n_b BIGINT, long_a ARRAY<BIGINT>, long_b ARRAY<BIGINT>")
    size = f"{like.den} * least(n_a, n_b) >= {like.num} * greatest(n_a, n_b)"
    left = {r.k for r in df.filter(f"{size} AND ({jaccard.may_link_closely(like)})").collect()}
    assert {k for k, yes in enumerate(linked) if yes} <= left
    # Of the large pairs that have little in common, few are left.
    far = [k for k, row in enumerate(rows) if row[1] > 1200 and not linked[k]]
    assert far and len(left & set(far)) <= len(far) // 3


@pytest.mark.parametrize("like", [Likeness(3, 9, 10), Likeness(5, 4, 5)])
def test_sets_with_nothing_in_common_do_not_meet(like):
    """Pieces of 64 bits with a few bits set are the same by chance, the more the more sets."""
    draw = np.random.default_rng(7)
    keys = [piece_keys(np.unique(draw.integers(0, 2**64, 150, dtype=np.uint64)), like) for _ in range(2000)]
    _, times = np.unique(np.concatenate(keys), return_counts=True)
    assert len(times) > 2000 and times.max() == 1
