"""Cleaning of posts that keep arriving.

The rules are row by row, so the same expressions run on a stream without state.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import clean_posts
from ..sources.readers import CSV_OPTIONS, UNSUPPORTED


def clean_stream(
    spark: SparkSession, source: str, schema: T.StructType | str, target: str, checkpoint: str,
    text_col: str = "text", fmt: str = "parquet", available_now: bool = True,
    max_files: int = 10_000,
) -> StreamingQuery:
    """Clean every new file of a folder into a Parquet folder, each row once.

    ``checkpoint`` and ``target`` must be on storage that outlives the executors.
    ``max_files`` bounds one micro-batch, so a backlog is worked off in steps.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(UNSUPPORTED)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine=True)
    writer = (
        clean_posts(reader.format(fmt).load(source), text_col)
        .writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
