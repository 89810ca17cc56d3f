"""Rows numbered in the order of their files, without a sort and without one task.

A row's place in its file comes from the file itself.  Rows are counted by file; where a
file begins among all rows is the sum of the counts of the files before it, one number a
file, which the driver adds up (it lists the files anyway).  Files of a table come in the
natural order of their paths, tables in the order they are given in.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import detect_format, read_posts, union_splits
from .writers import scratch_path, write_parquet

INDEX = "row_index"
_FILE, _BLOCK, _PLACE = "__file", "__block", "__place"
# The files' offsets are sent to all tasks if there are so many at most, some 60 MB.
MOST_SENT = 200_000


def natural(path: str) -> list:
    """A sort key under which part-9 comes before part-10."""
    return [int(part) if part.isdigit() else part for part in re.split(r"(\d+)", path)]


def located(df: DataFrame, fmt: str) -> DataFrame:
    """``df``, as read from files, with each row's file, block and place.

    Parquet files number their rows.  Rows of CSV files are stored with the running
    number that their task gives them, which counts the rows of a block in order.
    """
    if fmt == "parquet":
        return df.select("*", F.col("_metadata.file_path").alias(_FILE), F.lit(0).cast("long").alias(_BLOCK),
                         F.col("_metadata.row_index").alias(_PLACE))
    path = scratch_path(df.sparkSession, "located")
    write_parquet(df.select("*", F.col("_metadata.file_path").alias(_FILE),
                            F.col("_metadata.file_block_start").alias(_BLOCK),
                            F.monotonically_increasing_id().alias(_PLACE)), path)
    return df.sparkSession.read.parquet(path)


def with_row_index(tables: Sequence[DataFrame], fmt: str = "parquet",
                   name: str = INDEX) -> list[DataFrame]:
    """Each table, as read from files, with its rows' numbers: 0 to n - 1 over all tables."""
    out, before = [], 0
    for table in tables:
        rows = located(table, fmt)
        blocks = rows.groupBy(_FILE, _BLOCK).agg(
            F.min(_PLACE).alias("first"), F.count(F.lit(1)).alias("n")).collect()
        shifts = []
        for block in sorted(blocks, key=lambda b: (natural(b[_FILE]), b[_BLOCK])):
            shifts.append((block[_FILE], block[_BLOCK], before - block["first"]))
            before += block["n"]
        offsets = table.sparkSession.createDataFrame(
            shifts, f"{_FILE} STRING, {_BLOCK} BIGINT, __shift BIGINT")
        if len(shifts) <= MOST_SENT:
            offsets = F.broadcast(offsets)
        joined = rows.join(offsets, [_FILE, _BLOCK])
        out.append(joined.select(
            *(F.col(f"`{c}`") for c in table.columns), (F.col(_PLACE) + F.col("__shift")).alias(name)))
    return out


def load_numbered_splits(
    spark: SparkSession, paths: dict[str, str], fmt: str | None = None,
    schema: T.StructType | str | None = None, name: str = INDEX,
) -> DataFrame:
    """One table from one path per split, its rows numbered from 0 in the order of the
    splits, of their files and of the rows in a file."""
    kinds = {fmt or detect_format(path) for path in paths.values()}
    if len(kinds) != 1:
        raise ValueError("splits to be numbered must have one format")
    tables = [read_posts(spark, path, fmt, schema) for path in paths.values()]
    return union_splits(dict(zip(paths, with_row_index(tables, *kinds, name))))
