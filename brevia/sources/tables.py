"""Tables that are laid out for the joins and filters to come.

A table bucketed by a key joins others on it without being moved again; one folder for
each value of a column lets readers of one value skip the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .writers import scratch_path


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None,
                  by: str | None = None, path: str | None = None) -> str:
    """Save ``df`` as a table bucketed and sorted by ``key``, with a folder for each value
    of ``by``; the table's name.

    Rows are sent to their buckets first, so that a bucket is one file for each value of
    ``by``; written where they are, every task would make a file for each bucket.  A bucket
    is read by one task, so take a number that makes buckets of a few hundred MB.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    if by is not None:
        writer = writer.partitionBy(by)
    table = f"{name}_{uuid.uuid4().hex}"
    writer.option("path", path or scratch_path(spark, name)).saveAsTable(table)
    return table


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
