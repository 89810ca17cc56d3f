"""A stream of files gives the same rows as the batch job."""

import pytest
from pyspark.sql import functions as F

from brevia.operators.cleaning import clean_posts
from brevia.sources.synthetic import generate_posts
from brevia.sources.writers import scratch_path, write_csv, write_parquet
from brevia.streaming.cleaning import clean_stream


@pytest.mark.parametrize("fmt,write", [("parquet", write_parquet), ("csv", write_csv)])
def test_stream_equals_batch(spark, fmt, write):
    source, target, offsets = (scratch_path(spark, n) for n in ("in", "out", "offsets"))
    posts = generate_posts(spark, 300).withColumn("text", F.concat("text", F.lit("\nline two")))

    def run():
        clean_stream(spark, source, posts.schema, target, offsets, fmt=fmt).awaitTermination()

    write(posts.filter("id < 100"), source)
    run()
    write(posts.filter("id >= 100"), source, mode="append")
    run()
    found, batch = spark.read.parquet(target), clean_posts(posts)
    assert found.count() == 300
    assert found.exceptAll(batch).count() == 0 and batch.exceptAll(found).count() == 0


def test_other_formats_fail(spark):
    with pytest.raises(ValueError, match="CSV or Parquet"):
        clean_stream(spark, "x", "text string", "y", "z", fmt="json")
