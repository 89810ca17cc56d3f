"""Reading posts from CSV and Parquet."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the message for a file that is neither CSV nor Parquet.
UNSUPPORTED = "Unsupported input format. Use CSV or Parquet."
FORMATS = {".csv": "csv", ".parquet": "parquet"}

# Quotes are doubled and fields may hold line breaks, as common CSV writers do it;
# Spark's defaults would trim the fields and cut such rows.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# On reading, a field is null if nothing stands between the commas; quotes around nothing
# are an empty text.
READ_OPTIONS = {**CSV_OPTIONS, "nullValue": "\x00"}


def detect_format(path: str) -> str:
    try:
        return FORMATS[PurePosixPath(path.rstrip("/")).suffix]
    except KeyError:
        raise ValueError(UNSUPPORTED) from None


def read_posts(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read a table of posts; the format follows the extension unless given.

    A CSV row with too many or too few fields, or a field that is not of its column's
    type, ends the job; ``checked_csv`` sets such rows aside instead.

    A CSV file with line breaks inside fields cannot be split, so one such file is
    one task: keep many files, or pass ``multi_line=False`` if no field has a break.
    In a file whose rows end in CRLF, Spark reads a CRLF inside a field as LF.
    Without a schema every CSV column is read as string, which saves a second scan.
    """
    fmt = fmt or detect_format(path)
    if fmt == "parquet":
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    if fmt == "csv":
        # Without pruning the fields are counted whichever columns are asked for.
        reader = spark.read.options(**READ_OPTIONS, multiLine=multi_line, mode="FAILFAST",
                                    columnPruning=False)
        return (reader if schema is None else reader.schema(schema)).csv(path)
    raise ValueError(UNSUPPORTED)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Share out a table that has fewer files than there are cores.

    Text rules cost far more than moving the text, so a file that cannot be split
    is worth one shuffle.  A table of many files, as any large one is, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores, *keys)


def require_text_column(df: DataFrame, name: str = "text") -> DataFrame:
    """Fail before any job runs if the text column is missing or not a string."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r}; columns are {', '.join(df.columns)}")
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise TypeError(f"column {name!r} is {df.schema[name].dataType.simpleString()}, not string")
    return df


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All rows of all splits, duplicates kept, with the split's name as a column."""
    named = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(DataFrame.unionByName, named)


def load_splits(
    spark: SparkSession, paths: dict[str, str], fmt: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """One labelled table from one path per split."""
    return union_splits({
        name: read_posts(spark, path, fmt, schema) for name, path in paths.items()
    })
