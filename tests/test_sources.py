"""Reading, writing, splits and synthetic posts."""

import csv

import pytest
from pyspark.sql import functions as F

from brevia.functions.clean import clean_text
from brevia.operators.cleaning import clean_file, clean_posts
from brevia.sources import synthetic
from brevia.sources.readers import (
    UNSUPPORTED, detect_format, load_splits, read_posts, require_text_column, spread, union_splits,
)
from brevia.sources.writers import scratch_path, write_csv, write_parquet

ODD_TEXTS = [
    "plain", "with, comma", 'with "quotes"', "two\nlines", "cr\r\nlf", "back\\slash \\\"", "  spaces  ",
    "tab\there", "ação 😊", "'single'", "#tag @user",
]


def test_csv_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    path = str(tmp_path / "posts.csv")
    write_csv(spark.createDataFrame(rows, "id int, text string"), path)
    back = read_posts(spark, path, schema="id int, text string")
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_csv_of_another_writer(spark, tmp_path):
    path = tmp_path / "posts.csv"
    with open(path, "w", newline="", encoding="utf-8") as file:
        writer = csv.writer(file)
        writer.writerow(["text"])
        writer.writerows([t] for t in ODD_TEXTS)
    # Rows of this writer end in CRLF; Spark then reads one inside a field as LF.
    expected = sorted(t.replace("\r\n", "\n") for t in ODD_TEXTS)
    assert sorted(r.text for r in read_posts(spark, str(path)).collect()) == expected


def test_format_follows_extension_and_others_fail(spark):
    assert detect_format("/a/b.csv") == "csv" and detect_format("x/y.parquet/") == "parquet"
    for call in (lambda: detect_format("a.json"), lambda: read_posts(spark, "a.txt"),
                 lambda: read_posts(spark, "a.csv", fmt="orc")):
        with pytest.raises(ValueError, match=UNSUPPORTED):
            call()


def test_text_column_is_checked(spark):
    df = spark.createDataFrame([(1, "x")], "n int, body string")
    with pytest.raises(ValueError, match="no column 'text'"):
        require_text_column(df)
    with pytest.raises(TypeError, match="is int"):
        clean_posts(df, "n")
    assert clean_posts(df, "body").columns == ["n", "body", "body_cleaned"]


def test_clean_file_keeps_columns_and_names_the_new_one(spark, tmp_path):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out.parquet")
    write_csv(spark.createDataFrame([("7", "Hi @Bob", "x"), ("8", None, "y")],
                                    "id string, text string, tag string"), source)
    clean_file(spark, source, target)
    rows = {r.id: r for r in spark.read.parquet(target).collect()}
    assert rows[7].asDict() == {"id": 7, "text": "Hi @Bob", "tag": "x", "text_cleaned": "hi @user"}
    assert rows[8].text is None and rows[8].text_cleaned == ""


def test_clean_file_keeps_types_empty_texts_and_order(spark, tmp_path):
    source, target = str(tmp_path / "in.csv"), str(tmp_path / "out.parquet")
    rows = [(2, "", 1.5), (1, None, None), (3, 'say "hi", @x', 0.0)]
    write_csv(spark.createDataFrame(rows, "id int, text string, score double").coalesce(1), source)
    clean_file(spark, source, target)
    back = spark.read.parquet(target)
    assert [f.dataType.simpleString() for f in back.schema] == ["int", "string", "double", "string"]
    assert [tuple(r)[:3] for r in back.collect()] == rows


def test_splits_are_named_and_pruned(spark):
    df = spark.createDataFrame(
        [(1, "a", "train"), (2, "b", "test"), (3, "b", "train")], "id int, text string, split string"
    )
    path = scratch_path(spark, "splits")
    write_parquet(df, path, by_split=True)
    loaded = load_splits(spark, {n: f"{path}/split={n}" for n in ("train", "test")}, "parquet")
    assert sorted((r.id, r.split) for r in loaded.collect()) == [(1, "train"), (2, "test"), (3, "train")]
    one = spark.read.parquet(path).filter("split = 'train'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and one.count() == 2


def test_union_keeps_duplicates(spark):
    df = spark.createDataFrame([("a",)], "text string")
    assert union_splits({"train": df, "test": df}).count() == 2


def test_spread_only_widens(spark):
    one, many = scratch_path(spark, "one"), scratch_path(spark, "many")
    write_parquet(spark.range(100).coalesce(1), one)
    assert spread(spark.read.parquet(one), "id").rdd.getNumPartitions() == 8
    write_parquet(spark.range(0, 100, 1, 20), many)
    wide = spark.read.parquet(many)
    assert spread(wide, "id") is wide


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_synthetic_posts_do_not_depend_on_partitions(spark):
    few = synthetic.generate_posts(spark, 500)
    many = synthetic.synthetic_posts(spark.range(0, 500, 1, 13))
    assert few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
    other = synthetic.generate_posts(spark, 500, seed=7)
    assert few.join(other, ["id", "text"]).count() < 400


def test_synthetic_odds(spark):
    n = 20000
    df = synthetic.generate_posts(spark, n)
    ends = {name: [" " + x for x in pool] for name, pool in
            (("url", synthetic.URLS), ("tag", synthetic.HASHTAGS), ("emoji", synthetic.EMOJIS))}
    share = {name: df.filter(F.lit(False) if not pool else F.col("text").rlike(
        "(" + "|".join(p.replace(".", r"\.") for p in pool) + ")( |$)")).count() / n
        for name, pool in ends.items()}
    lead = df.filter(F.col("text").rlike(r"^@user[123] ")).count() / n
    assert abs(lead - synthetic.USER_ODDS) < 0.01
    assert abs(share["url"] - synthetic.URL_ODDS) < 0.01
    assert abs(share["tag"] - synthetic.HASHTAG_ODDS) < 0.012
    bases = df.filter(F.col("text").contains(synthetic.BASE_TEXTS[4])).count() / n
    assert abs(bases - 0.1) < 0.01
    assert df.filter(clean_text(F.col("text")).rlike("https?:")).count() == 0
