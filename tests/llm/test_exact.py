"""Streaming exact deduplication against plain grouping."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from brevia.llm import exact
from brevia.llm.exact import Names, deduplicated, groups, members, take_in
from brevia.sources.writers import scratch_path


def plain(text):
    return re.sub("[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    """id -> [(text, keep_id, group_size)], by grouping whole contents."""
    by_content = {}
    for key, text in rows:
        by_content.setdefault(plain(text), []).append((key, text))
    out = []
    for content, own in by_content.items():
        keep = min(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(key, keep, len(own), digest) for key, _ in own]
    return sorted(out, key=repr)


def rows_of(df):
    found = df.select("id", "keep_id", "group_size", "text_sha256").collect()
    return sorted((tuple(r) for r in found), key=repr)


def kept_once(df):
    per = df.groupBy("text_sha256").agg(F.count_if("kept").alias("n"), F.max("group_size").alias("g"),
                                        F.count(F.lit(1)).alias("rows"))
    return per.filter("n <> 1 OR g <> rows").isEmpty()


PARTS = [
    [(5, "a b"), (3, "ab"), (8, "x"), (9, None)],
    [(1, "ab"), (2, " a\tb\n"), (8, "x"), (4, "é é"), (None, "x")],
    [(7, ""), (6, " \v\f\r "), (11, "é é "), (12, "a  b  "), (None, None), (13, "só 😀")],
]


def write_parts(make_docs, path, parts, mode="append"):
    for part in parts:
        make_docs(part, True).coalesce(1).write.mode(mode).parquet(path)


def test_arriving_files_hit_what_came_before(spark, make_docs):
    path, folder = scratch_path(spark, "arriving") + ".parquet", scratch_path(spark, "exact")
    rows = []
    for turn, part in enumerate(PARTS):
        write_parts(make_docs, path, [part])
        rows += part
        found = deduplicated(spark, path, folder, max_files=1)
        assert rows_of(found) == brute(rows) and kept_once(found)
        batches = spark.read.parquet(f"{folder}/groups").select("batch").distinct().count()
        assert batches == turn + 1  # files that were read are not read again
    assert {p["batch"] for p in spark.read.parquet(f"{folder}/groups").filter(
        F.col("group_size") > 1).collect()} == {0, 1, 2}


def test_many_files_in_small_batches(spark, make_docs, odd_rows):
    path = scratch_path(spark, "files") + ".parquet"
    rows = [(k, f"text {k % 7} " + " " * (k % 5)) for k in range(60)] + odd_rows
    make_docs(rows).repartition(9).write.parquet(path)
    found = deduplicated(spark, path, scratch_path(spark, "exact"), max_files=2)
    assert rows_of(found) == brute(rows) and kept_once(found)


def test_a_batch_that_failed_is_done_again(spark, make_docs, monkeypatch):
    path, folder = scratch_path(spark, "files") + ".parquet", scratch_path(spark, "exact")
    write_parts(make_docs, path, PARTS[:2])
    take_in(spark, path, folder)
    write_parts(make_docs, path, PARTS[2:])
    writer = type(spark.range(0).write)
    plain_write = writer.parquet

    def broken(self, target, *args, **kwargs):
        if "/groups/batch=1" in target:
            plain_write(self, target, *args, **kwargs)
            raise OSError("lost after it was written")
        return plain_write(self, target, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", broken)
    with pytest.raises(Exception, match="lost after it was written"):
        take_in(spark, path, folder)
    monkeypatch.undo()
    found = deduplicated(spark, path, folder)
    rows = sum(PARTS, [])
    assert rows_of(found) == brute(rows) and kept_once(found)


@pytest.mark.parametrize("sent", [0, exact.SENT_BYTES])
def test_equal_digests_of_unlike_contents(spark, make_docs, sent):
    path, folder = scratch_path(spark, "files") + ".parquet", scratch_path(spark, "exact")
    rows = sum(PARTS, []) + [(20 + k, f"t{k % 4}") for k in range(12)]
    write_parts(make_docs, path, [rows[:9], rows[9:]])
    weak = Names(digest=lambda body: F.encode(F.substring(body, 1, 1), "UTF-8"))
    take_in(spark, path, folder, weak, max_files=1)
    found = members(spark.read.parquet(path), groups(spark, folder), weak, sent)
    assert rows_of(found) == brute(rows) and kept_once(found)


def test_empty_table_and_settings(spark, make_docs):
    path = scratch_path(spark, "none") + ".parquet"
    make_docs([]).write.parquet(path)
    before = {name: spark.conf.get(name, None) for name in exact.STATE}
    assert deduplicated(spark, path, scratch_path(spark, "exact")).count() == 0
    assert before == {name: spark.conf.get(name, None) for name in exact.STATE}


def test_string_identifiers(spark):
    path = scratch_path(spark, "named") + ".parquet"
    spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "xy  ")], "name STRING, body STRING"
                          ).write.parquet(path)
    found = deduplicated(spark, path, scratch_path(spark, "exact"), Names("name", "body"))
    assert {r["keep_id"] for r in found.collect()} == {None}
    assert found.filter("kept").count() == 1
