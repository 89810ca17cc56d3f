"""Writing posts, and the place for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .readers import CSV_OPTIONS


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and without row numbers."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_parquet(
    df: DataFrame, path: str, by_split: bool = False, mode: str = "errorifexists",
    group_bytes: int | None = None,
) -> None:
    """Parquet; ``by_split`` makes one folder per split so that readers of one
    split skip the files of the others.  A row group, which one task writes and one reads,
    has ``group_bytes``, or as many as the session says."""
    writer = df.write.mode(mode)
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    (writer.partitionBy("split") if by_split else writer).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``.

    Where the session names none and Spark runs on this machine alone, as in tests,
    the warehouse folder serves.  What is written there goes when the session's JVM ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
