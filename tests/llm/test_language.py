import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.llm import language
from brevia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    found = QUERIES["op1_hyperdimensional_language"](spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_gram_vector_is_product_of_rotated_letters():
    vectors = language.Vectors(64)
    a, b, c = (vectors.letter(ord(x)) for x in "abc")
    packed, counts = language.grams("abc")
    assert len(packed) == 3 and counts.sum() == 3
    middle = ord("a") << 42 | ord("b") << 21 | ord("c")
    assert np.array_equal(vectors.gram(middle), np.roll(a, 2) * np.roll(b, 1) * c)
    total = sum(vectors.gram(int(p)) * n for p, n in zip(packed, counts))
    assert np.allclose(vectors.bundle(packed, counts), total)


def test_bundle_does_not_depend_on_what_is_kept():
    packed, counts = language.grams("the quick brown fox jumps over the lazy dog " * 3)
    assert np.allclose(language.Vectors(32, most=7).bundle(packed, counts),
                       language.Vectors(32).bundle(packed, counts))


def test_odd_rows(spark, make_docs, odd_rows):
    train = make_docs([(i, "the cat and the dog are in the house", "en") for i in range(9)]
                      + [(i, "der hund und die katze sind im haus", "de") for i in range(9, 18)]
                      + [(20, "who knows", None), (21, None, "de"), (22, "123 456", "en")])
    learnt = language.profiles(train)
    assert list(learnt) == ["de", "en"]
    docs = make_docs([*odd_rows, (1, "the dog"), (1, "the dog"), (2, "die katze"), (3, "12 !?")], True)
    rows = language.predict(docs, learnt, score="how_near").collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["how_near"], r["score"]))
    for key in (900, 901, 902, 3):
        assert by[key] == [("und", 0.0, 2)]
    assert [x[0] for x in by[1]] == ["en", "en"] and by[2][0][0] == "de"
    assert len(rows) == len(odd_rows) + 4


def test_empty_and_unlabelled(make_docs):
    none = make_docs([])
    assert language.profiles(none) == {}
    assert language.predict(none, {}).count() == 0
    row = language.predict(make_docs([(1, "some text")]), language.profiles(make_docs([(1, "a b")]))).first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_held_out_rule(spark):
    import zlib
    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("text", ["", "  ", "1234", "!?"])
def test_no_letters_no_grams(text):
    assert not len(language.grams(text)[0])
