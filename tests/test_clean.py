"""Cleaning rules: known strings, properties and a row-by-row comparison with ``re``."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brevia.functions import clean
from brevia.operators.cleaning import clean_posts

FULL = "E aí @joao, beleza? Adoro programar em #python 😊 https://site.com"
FULL_CLEAN = "e aí @user, beleza? adoro programar em python :smiling_face_with_smiling_eyes: [url]"

KNOWN = [
    (clean.remove_urls, "Aqui está o link https://site.com para ver", "Aqui está o link [URL] para ver"),
    (clean.remove_urls, "https://site.com", "[URL]"),
    (clean.remove_urls, "HTTP://a.b ftp://c", "HTTP://a.b ftp://c"),
    (clean.remove_urls, " \t a \n b  \x1f", "a \n b"),
    (clean.remove_mentions, "E aí @joao, beleza?", "E aí @user, beleza?"),
    (clean.remove_mentions, "Feliz ano novo @ana e @carlos!", "Feliz ano novo @user e @user!"),
    (clean.remove_mentions, "@joão a@b.com @@x @ .", "@user a@user.com @@user @ ."),
    (clean.normalize_hashtags, "Adoro programar em #python", "Adoro programar em python"),
    (clean.normalize_hashtags, "Adoro programar em #python3", "Adoro programar em python3"),
    (clean.normalize_hashtags, "# ##a #ção #x²", "# #a ção x²"),
    (clean.to_lowercase, "Olá Mundo", "olá mundo"),
    (clean.to_lowercase, "OLÁ MUNDO", "olá mundo"),
    (clean.handle_emojis, "Estou feliz 😊", "Estou feliz :smiling_face_with_smiling_eyes:"),
    (clean.handle_emojis, "😊", ":smiling_face_with_smiling_eyes:"),
    (clean.clean_text, FULL, FULL_CLEAN),
    (clean.clean_text, "  " + FULL, FULL_CLEAN),
    (clean.clean_text, "Check @john's post! #AI is amazing 😊 https://example.com",
     "check @user's post! ai is amazing :smiling_face_with_smiling_eyes: [url]"),
    (clean.clean_text, "see https://x.y/@me#tag end", "see [url] end"),
]


@pytest.mark.parametrize("rule,text,expected", KNOWN)
def test_known_strings(one, rule, text, expected):
    assert one(rule, text) == expected


def test_null_becomes_empty(one):
    assert one(clean.clean_text, None) == ""


# What the rules say in Python's own terms.
STEPS = {
    "urls": (clean.remove_urls, lambda t: re.sub(r"https?://\S+", "[URL]", t).strip()),
    "mentions": (clean.remove_mentions, lambda t: re.sub(r"@\w+", "@user", t)),
    "hashtags": (clean.normalize_hashtags, lambda t: re.sub(r"#(\w+)", r"\1", t)),
    "lower": (clean.to_lowercase, str.lower),
}
PIECES = st.sampled_from([
    "http://", "https://", "a.b/c?d=1", "@", "#", "_", "joão", "Ação", "ÑÜ", "x²", "½", "Ⅷ", "٣",
    "नमस्ते", "привет", "ΣΑΣ", "日本", "ß", "İ", " ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x1f",
    " ", " ", " ", "　", ".", ",", "!", "-", "'", '"', "\\", "$1", "😊", "RT", "é",
    "‍", "‿", "0", "Z",
])
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=60)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=TEXTS)
def test_rules_equal_python_row_by_row(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = rows.select("id", *(rule(F.col("text")).alias(n) for n, (rule, _) in STEPS.items()))
    for row in found.collect():
        for name, (_, python) in STEPS.items():
            assert row[name] == python(texts[row.id]), (name, texts[row.id])


def test_mentions_and_case_are_idempotent(spark):
    texts = ["a @b c@d @@e", "ÀÉ İ ΣΑΣ", "# ##x #y"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for rule in (clean.remove_mentions, clean.to_lowercase):
        once = rule(F.col("text"))
        assert df.filter(~once.eqNullSafe(rule(once))).count() == 0


def test_column_and_frame_forms_agree(spark):
    texts = [t for _, t, _ in KNOWN] + [None, "", "1️⃣ 🇧🇷 👨‍👩‍👧 ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    both = clean_posts(df).withColumn("by_column", clean.clean_text(F.col("text")))
    assert both.filter(~F.col("text_cleaned").eqNullSafe(F.col("by_column"))).count() == 0


def test_cleaning_is_one_narrow_native_step(spark, tmp_path):
    spark.createDataFrame([(1, "a", "b")], "id int, text string, other string").write.parquet(
        str(tmp_path / "t.parquet"))
    df = clean_posts(spark.read.parquet(str(tmp_path / "t.parquet"))).select("id", "text_cleaned")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<id:int,text:string>" in plan


def test_synthetic_posts_equal_a_plain_loop(spark):
    from bench import python_cleaner
    from brevia.functions.emoji_names import default_names
    from brevia.operators.parity import parity_check
    from brevia.sources.synthetic import generate_posts

    clean_one = python_cleaner(default_names(spark))
    posts = generate_posts(spark, 1000)
    rows = [(r.id, clean_one(r.text)) for r in posts.collect()]
    loop = spark.createDataFrame(rows, "id long, text_cleaned string")
    found = parity_check(loop, clean_posts(posts), "text_cleaned").first()
    assert found.all_match and found.n_left == found.n_right == 1000
