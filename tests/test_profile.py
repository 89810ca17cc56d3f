"""Profile operators against plain numpy and Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevia.functions import text
from brevia.operators import profile


@pytest.fixture(scope="module")
def posts(spark):
    rng = np.random.default_rng(3)
    words = ["a", "bb", "ccc", "#tag", "@user", "RT", "http://x.y", "😀", "🤔", "END"]
    rows = []
    for i in range(400):
        size = int(rng.integers(0, 30))
        split = ["train", "train", "train", "validation", "test"][i % 5]
        rows.append((i, split, int(rng.integers(0, 3)), " ".join(rng.choice(words, size))))
    return spark.createDataFrame(rows, "id long, split string, label int, text string").cache()


def by_split(posts):
    groups = {}
    for row in posts.collect():
        groups.setdefault(row.split, []).append(row)
    return groups


def test_counts_and_balance(posts):
    groups = by_split(posts)
    assert {r.split: r.n_rows for r in profile.split_counts(posts).collect()} == {
        s: len(rows) for s, rows in groups.items()}
    for r in profile.class_balance(posts).collect():
        same = [x for x in groups[r.split] if text_name(x.label) == r.label_name]
        assert r.n_rows == len(same)
        assert r.pct == pytest.approx(100 * len(same) / len(groups[r.split]))


def test_classes_by_count(posts):
    shown = profile.by_count(profile.class_balance(posts)).collect()
    assert [(r.split, r.n_rows) for r in shown] == sorted((r.split, r.n_rows) for r in shown)


def text_name(label):
    return ["negative", "neutral", "positive"][label]


def test_label_names_both_ways(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (-1,), (None,)], "label int")
    names = [r.label_name for r in profile.with_label_name(df).collect()]
    assert names == ["negative", "neutral", "positive", None, None, None]
    back = df.select(text.label_id(text.label_name(F.col("label"))).alias("x")).collect()
    assert [r.x for r in back] == [0, 1, 2, None, None, None]


def test_length_stats(posts):
    groups = by_split(posts)
    for r in profile.length_stats(posts).collect():
        chars = np.array([len(x.text) for x in groups[r.split]])
        words = np.array([len(x.text.split()) for x in groups[r.split]])
        expected = [chars.mean(), np.median(chars), chars.max(), np.quantile(chars, 0.95),
                    words.mean(), np.median(words)]
        assert list(r)[1:] == pytest.approx(list(np.round(expected, 1)))


def test_token_quantiles(posts):
    pattern = re.compile(r"\w+|[^\w\s]")
    sizes = [len(pattern.findall(r.text)) for r in posts.collect()]
    row = profile.token_quantiles(posts).first()
    assert (row.p95, row.p99) == pytest.approx(tuple(np.quantile(sizes, [0.95, 0.99])))


def test_histogram_equals_numpy(posts):
    groups = by_split(posts)
    found = {}
    for r in profile.length_histogram(posts).collect():
        found.setdefault((r.split, r.metric), {})[r.bin] = r
    measure = {"chars": lambda t: len(t), "words": lambda t: len(t.split())}
    for (split, metric), bins in found.items():
        values = [measure[metric](x.text) for x in groups[split]]
        counts, edges = np.histogram(values, 20)
        assert [bins[b].n_rows for b in range(20)] == list(counts)
        assert [bins[b].bin_start for b in range(20)] == pytest.approx(list(edges[:-1]))
        assert bins[19].bin_end == pytest.approx(edges[-1])
        assert bins[0].median == np.median(values)


@pytest.mark.parametrize("values", [[5], [3] * 9, [0, 100], list(range(101)), [1, 1, 2, 50]])
def test_histogram_corner_cases(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    counts = profile.value_counts(df, {"v": F.col("v")})
    rows = sorted(profile.histogram(counts).collect(), key=lambda r: r.bin)
    expected, edges = np.histogram(values, 20)
    if values == list(range(101)):
        # Whole-number bins: 5 values in each, 6 in the closed last one.
        expected = [5] * 19 + [6]
    assert [r.n_rows for r in rows] == list(expected)
    assert rows[0].bin_start == edges[0] and rows[-1].bin_end == edges[-1]


@pytest.mark.parametrize("scale", [1, 7])
def test_automatic_bins_equal_numpy(spark, scale):
    rng = np.random.default_rng(scale)
    values = [int(v) * scale for v in rng.poisson(40, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    counts = profile.value_counts(df, {"v": F.col("v")})
    rows = profile.histogram(counts, bins="auto").collect()
    assert len(rows) == len(np.histogram_bin_edges(np.array(values), "auto")) - 1
    assert sum(r.n_rows for r in rows) == len(values)


def test_noise_flags(spark):
    cases = {
        "hi @user": "mentions", "hi @ana": None, "see http://a": "urls", "http:// ": None,
        "#!": "hashtags", "# ": None, "RT x": "retweets", "x (RT)": "retweets", "ART": None,
        "RTx": None, "éRT": None, "RT_": None, "😀": "emojis", "🤔": None, "☕": None, "🚀": "emojis",
        "🇧🇷": "emojis", "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    for row in profile.with_noise_flags(df).collect():
        hits = [p for p in text.NOISE if row[f"has_{p}"]]
        assert hits == ([cases[row.text]] if cases[row.text] else []), row


def test_noise_profile_is_of_the_train_split(posts):
    train = [r.text for r in by_split(posts)["train"]]
    rows = {r.pattern: r for r in profile.noise_profile(posts).collect()}
    assert rows["mentions"].occurrences == sum("@user" in t for t in train)
    assert rows["retweets"].occurrences == sum(bool(re.search(r"\bRT\b", t)) for t in train)
    assert rows["emojis"].pct == pytest.approx(100 * sum("😀" in t for t in train) / len(train))


def test_noise_profile_of_nothing(posts):
    rows = profile.noise_profile(posts, split="none").collect()
    assert [(r.occurrences, r.pct) for r in rows] == [(0, None)] * 5


@pytest.mark.parametrize("n", [5, 1500])
def test_samples(posts, n):
    rows = profile.sample_per_class(posts, n).collect()
    sizes = {name: sum(text_name(r.label) == name for r in posts.collect())
             for name in ("negative", "neutral", "positive")}
    for name, size in sizes.items():
        ranks = sorted(r.sample_rank for r in rows if r.label_name == name)
        assert ranks == list(range(1, min(n, size) + 1))
    again = profile.sample_per_class(posts.repartition(3), n).collect()
    assert sorted((r.id, r.sample_rank) for r in rows) == sorted((r.id, r.sample_rank) for r in again)
    assert {r.id for r in rows if r.sample_rank <= 5} != {
        r.id for r in profile.sample_per_class(posts, n, seed=1).collect() if r.sample_rank <= 5}


def test_samples_of_all_sizes_have_the_same_order(posts, monkeypatch):
    small = profile.sample_per_class(posts, 20).select("id", "sample_rank")
    monkeypatch.setattr(profile, "GROUP_LIMIT", 10)
    salted = profile.sample_per_class(posts, 20).select("id", "sample_rank")
    assert small.exceptAll(salted).count() == 0 and small.count() == salted.count()


def test_samples_limit_before_the_shuffle(posts):
    plan = profile.sample_per_class(posts, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_text_measures(one):
    assert one(text.n_chars, "é😊 x") == 4 and one(text.n_chars, None) == 0
    assert one(text.n_words, "  a b\nc　d ") == 4 and one(text.n_words, None) == 0
    assert one(text.n_tokens, "don't @me 😊") == 6
    assert one(text.preview, "x" * 150) == "x" * 150
    assert one(text.preview, "x" * 151) == "x" * 150 + "..."
    assert one(text.mismatch_preview, "ab") == "ab..."
    assert one(text.banner_text, "neutral") == "NEUTRAL"
    assert one(text.title_text, "train") == "Train"


def test_percent_text(spark):
    df = spark.createDataFrame([(v,) for v in (12.34, 2.25, 100.0, 0.0)], "v double")
    shown = [r[0] for r in df.select(text.percent_text(F.col("v"))).collect()]
    assert shown == [f"{v:.1f}%" for v in (12.34, 2.25, 100.0, 0.0)]


def test_head_is_by_id(posts):
    assert [r.id for r in profile.head_rows(posts.orderBy(F.desc("id")), 5).collect()] == [0, 1, 2, 3, 4]
