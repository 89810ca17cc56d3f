"""Vocabulary, encoding and batch mapping against plain Python."""

import re
from collections import Counter

import pytest

from brevia.operators import tokens
from brevia.operators.mapping import map_batches
from brevia.sources.writers import scratch_path

PATTERN = re.compile(r"\w+|[^\w\s]")
TEXTS = ["the cat, the dog", "the @cat #1 😊", "", None, "unseen words here!", "the " * 50, "a b c d"]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")


def expected_vocabulary(size):
    counts = Counter(t for text in TEXTS for t in PATTERN.findall(text or ""))
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:size]
    return {token: i + len(tokens.SPECIAL_TOKENS) for i, (token, _) in enumerate(ranked)}


def expected_rows(vocabulary, max_length):
    rows = {}
    for i, text in enumerate(TEXTS):
        ids = [vocabulary.get(t, tokens.UNK) for t in PATTERN.findall(text or "")][: max_length - 2]
        ids = [tokens.BOS, *ids, tokens.EOS]
        pad = max_length - len(ids)
        rows[i] = (ids + [tokens.PAD] * pad, [1] * len(ids) + [0] * pad)
    return rows


def test_vocabulary(posts):
    found = {r.token: r.token_id for r in tokens.build_vocabulary(posts, 7).collect()}
    assert found == expected_vocabulary(7)


@pytest.mark.parametrize("max_length", [8, 64])
def test_encode(posts, max_length):
    encoded = tokens.encode(posts, tokens.build_vocabulary(posts, 7), max_length)
    assert encoded.columns == ["id", "input_ids", "attention_mask"]
    found = {r.id: (r.input_ids, r.attention_mask) for r in encoded.collect()}
    assert found == expected_rows(expected_vocabulary(7), max_length)


def test_rows_are_encoded_one_by_one(spark):
    rows = [(1, "a b c"), (1, "c c"), (None, "b a"), (None, None), (1, "a b c")]
    posts = spark.createDataFrame(rows, "id long, text string")
    vocabulary = tokens.build_vocabulary(posts, 3)
    ids = {r.token: r.token_id for r in vocabulary.collect()}
    found = [tuple(r.input_ids) for r in tokens.encode(posts, vocabulary, 8).collect()]
    expected = [tuple([tokens.BOS, *(ids[t] for t in (text or "").split()), tokens.EOS]) for _, text in rows]
    assert sorted(found) == sorted(e + (tokens.PAD,) * (8 - len(e)) for e in expected)


@pytest.mark.parametrize("size", [1000, 250_000])
def test_size_of_vocabulary_does_not_change_the_rows(spark, size):
    names = spark.range(size).selectExpr("concat('t', id) AS token", "CAST(id + 4 AS INT) AS token_id")
    posts = spark.createDataFrame([(1, "t7 t999 zzz"), (1, "t0")], "id long, text string")
    found = {tuple(r.input_ids) for r in tokens.encode(posts, names, 6).collect()}
    assert found == {(tokens.BOS, 11, 1003, tokens.UNK, tokens.EOS, tokens.PAD),
                     (tokens.BOS, 4, tokens.EOS, *[tokens.PAD] * 3)}


def test_too_large_vocabulary_is_refused(posts, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="at most"):
        tokens.encode(posts, tokens.build_vocabulary(posts, 7))


def test_small_vocabulary_needs_no_shuffle(posts):
    plan = tokens.encode(posts, tokens.build_vocabulary(posts, 7))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_ids_with_gaps_fail(spark, posts):
    gaps = spark.createDataFrame([("a", 4), ("b", 6)], "token string, token_id int")
    with pytest.raises(ValueError, match="without gaps"):
        tokens.encode(posts, gaps)


def test_stored_vocabulary(spark, posts):
    path = scratch_path(spark, "vocabulary")
    tokens.save_vocabulary(tokens.build_vocabulary(posts, 5), path)
    again = tokens.load_vocabulary(spark, path)
    assert {r.token: r.token_id for r in again.collect()} == expected_vocabulary(5)


def test_default_length():
    assert tokens.MAX_LENGTH == 128


def test_map_batches(spark, posts):
    def size(batch):
        return batch.assign(n=batch["text"].str.len().fillna(0).astype("int64"))

    mapped = map_batches(posts, size, "n long", remove_columns=["text"])
    assert mapped.columns == ["id", "n"]
    assert {r.id: r.n for r in mapped.collect()} == {i: len(t or "") for i, t in enumerate(TEXTS)}
