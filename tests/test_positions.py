"""Rows numbered in file order, comparison by place, and tables laid out for joins."""

import pytest
from pyspark.sql import functions as F

from brevia.operators.parity import parity_by_position, position_mismatches
from brevia.plans import queries
from brevia.plans.derived import bucketed_posts, labels
from brevia.sources import positions
from brevia.sources.positions import INDEX, load_numbered_splits, natural, with_row_index
from brevia.sources.tables import read_table, save_bucketed
from brevia.sources.writers import scratch_path, write_csv

SF = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    execution = df._jdf.queryExecution()
    return execution.explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def in_files(spark, sizes, fmt="parquet", column="text"):
    """Files whose n-th row, over all of them, is ``t<n>``."""
    path, before = scratch_path(spark, "files"), 0
    for k, size in enumerate(sizes):
        rows = spark.createDataFrame([(f"t{before + r}",) for r in range(size)], f"{column} STRING")
        folder = f"{path}/f{k}"
        if fmt == "csv":
            write_csv(rows.coalesce(1), folder)
        else:
            rows.coalesce(1).write.parquet(folder)
        before += size
    return path, [f"{path}/f{k}" for k in range(len(sizes))]


def test_natural_order():
    assert sorted(["p-10", "p-9", "p-100", "o-11"], key=natural) == ["o-11", "p-9", "p-10", "p-100"]


@pytest.mark.parametrize("most", [0, positions.MOST_SENT])
@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_numbers_follow_files_without_gaps(spark, fmt, most, monkeypatch):
    monkeypatch.setattr(positions, "MOST_SENT", most)
    # Twelve files, so that f10 comes after f9; large ones last, which Spark packs first.
    _, folders = in_files(spark, [3, 0, 7, 1, 1, 2, 5, 1, 1, 1, 40, 90], fmt)
    reader = spark.read.schema("text STRING").options(header=True)
    df = reader.format(fmt).load(folders)
    numbered = with_row_index([df], fmt)[0]
    assert sorted(numbered.collect(), key=lambda r: r[INDEX]) == [(f"t{n}", n) for n in range(152)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_one_large_file_in_many_tasks(spark, fmt):
    path, n = scratch_path(spark, "large"), 50_000
    df = spark.range(0, n, 1, 1).select(F.concat(F.lit("t"), "id", F.lit("x" * 20)).alias("text"))
    (df.write.option("parquet.block.size", 200_000).parquet(path) if fmt == "parquet" else write_csv(df, path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        read = spark.read.schema("text STRING").options(header=True).format(fmt).load(path)
        assert read.rdd.getNumPartitions() > 1
        numbered = with_row_index([read], fmt)[0]
        wrong = numbered.filter(F.col("text") != F.concat(F.lit("t"), INDEX, F.lit("x" * 20)))
        assert wrong.count() == 0 and numbered.select(INDEX).distinct().count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_splits_are_numbered_in_their_order(spark):
    path, (first, second) = in_files(spark, [4, 3])
    both = load_numbered_splits(spark, {"train": second, "test": first}, "parquet")
    assert [(r.split, r.text) for r in both.orderBy(INDEX).collect()] == [
        ("train", "t4"), ("train", "t5"), ("train", "t6"), ("test", "t0"), ("test", "t1"),
        ("test", "t2"), ("test", "t3")]
    with pytest.raises(ValueError, match="one format"):
        load_numbered_splits(spark, {"a": "x.csv", "b": "y.parquet"})


def test_comparison_by_place(spark):
    left = spark.read.parquet(*in_files(spark, [5, 20])[1])
    right = spark.read.parquet(*in_files(spark, [24, 1])[1])
    assert tuple(parity_by_position(left, right, "text").first()) == (25, 25, True, 0)
    path = scratch_path(spark, "other")
    changed = [(None if n == 7 else f"t{n}" if n not in (3, 24) else "other",) for n in range(25)]
    spark.createDataFrame(changed, "text STRING").coalesce(1).write.parquet(path)
    other = spark.read.parquet(path)
    assert tuple(parity_by_position(left, other, "text").first()) == (25, 25, False, 3)
    found = [tuple(r) for r in position_mismatches(left, other, "text", 2).collect()]
    assert found == [(3, "t3...", "other..."), (7, "t7...", None)]


def test_unequal_lengths_are_told_without_reading_texts(spark):
    left = spark.read.parquet(*in_files(spark, [5, 2])[1])
    right = spark.read.parquet(*in_files(spark, [4])[1])
    found = parity_by_position(left, right, "text")
    assert tuple(found.first()) == (7, 4, False, 3) and "Scan parquet" not in plan(found)


def test_equal_rows_in_another_order_differ(spark):
    left = spark.read.parquet(*in_files(spark, [4])[1])
    path = scratch_path(spark, "turned")
    spark.createDataFrame([("t1",), ("t0",), ("t2",), ("t3",)], "text STRING").coalesce(1).write.parquet(path)
    assert parity_by_position(left, spark.read.parquet(path), "text").first().mismatch_count == 2


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    return [part for part in plan(df).split("\n\n") if "Exchange" in part.split("\n")[0]
            and "Arguments" in part and "BroadcastExchange" not in part.split("\n")[0]]


@pytest.mark.parametrize("name", ["load_splits", "union_splits", "split_filter"])
def test_posts_are_joined_without_moving_texts(spark, no_broadcast, name):
    df = queries.QUERIES[name](spark, SF)
    assert all("text#" not in part for part in exchanges(df))
    assert "SinglePartition" not in plan(df) and "Window" not in plan(df)


def test_labels_go_to_the_bucketed_texts(spark, no_broadcast):
    table = bucketed_posts(spark, SF)
    moved = exchanges(table)
    assert len(moved) == 1 and "text#" not in moved[0] and "quality#" in moved[0]
    pruned = plan(table.filter("split = 'train'"))
    assert "PartitionFilters: [isnotnull(split" in pruned and "(split#" in pruned
    assert len(exchanges(table.filter("split = 'train'"))) == 1
    assert table.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_two_bucketed_tables_join_without_an_exchange(spark, no_broadcast):
    texts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS id", "text")
    left = read_table(spark, save_bucketed(texts, "texts", "id", 8))
    right = read_table(spark, save_bucketed(labels(spark, SF), "labels", "id", 8))
    joined = left.join(right, "id")
    assert not exchanges(joined) and joined.count() == right.count()


def test_training_reads_one_split_at_a_time(spark, no_broadcast, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.model, "train", lambda table, path: seen.append(table))
    monkeypatch.setattr(queries.model, "load", lambda path: None)
    monkeypatch.setattr(queries.model, "predict", lambda model, df: df.selectExpr(
        "id", "label", "1 AS pred", "array(0.1D, 0.2D, 0.7D) AS scores"))
    test = queries.q_train_predict(spark, SF)
    for part in (seen[0].filter("split = 'train'"), test):
        assert "PartitionFilters: [isnotnull(split" in plan(part)
        assert all("text#" not in p for p in exchanges(part))
