"""CSV rows that do not fit their table: found, set aside and counted, never lost.

A row is broken if it has too many or too few fields, or a field that is not of its
column's type.  Spark's reader would cut or fill up such a row.  Here it either ends the job
or goes, as it stands in the file, to a quarantine table.  A quote that is never closed
takes in what follows up to the end of its file, which no reader can tell from a long field.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import READ_OPTIONS, read_posts
from .writers import write_parquet

RECORD = "broken_record"
# Types that a column of texts may have, the narrowest first.
TYPES = ("int", "bigint", "double", "boolean", "date")
LONGEST_VALUE = 40


class Counts(NamedTuple):
    good: int
    broken: int


def lossless_schema(strings: DataFrame, keep: tuple[str, ...] = ()) -> T.StructType:
    """The narrowest type of each column that gives back every value's text, by one scan.

    So 007, 1.50 or an empty text keep their column a string.  Columns in ``keep`` and
    those without any value stay strings.
    """
    names = [name for name in strings.columns if name not in keep]

    def fits(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        # Casting a long text is dear, and no value of these types is long.
        same = (F.length(value) <= LONGEST_VALUE) & (value.try_cast(kind).cast("string") == value)
        return F.coalesce(F.bool_and(value.isNull() | F.coalesce(same, F.lit(False))), F.lit(True))

    if not names:
        return strings.schema
    checks = [fits(name, kind).alias(f"{place}_{kind}")
              for place, name in enumerate(names) for kind in TYPES]
    valued = [F.count(F.col(f"`{name}`")).alias(f"{place}_n") for place, name in enumerate(names)]
    found = strings.agg(*checks, *valued).first()

    def kind_of(name: str) -> str:
        if name not in names or not found[f"{names.index(name)}_n"]:
            return "string"
        place = names.index(name)
        return next((kind for kind in TYPES if found[f"{place}_{kind}"]), "string")

    simple = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
              "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
    return T.StructType([T.StructField(f.name, simple[kind_of(f.name)]) for f in strings.schema])


def read_records(spark: SparkSession, path: str, schema: T.StructType | str,
                 multi_line: bool = True, header: bool = True) -> DataFrame:
    """The columns of ``schema`` and the whole record of each broken row, else null."""
    columns = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if RECORD in columns.names:
        raise ValueError(f"a column may not be called {RECORD}")
    whole = T.StructType([*columns, T.StructField(RECORD, T.StringType())])
    # Without pruning the number of fields is checked whichever columns are asked for.
    options = {**READ_OPTIONS, "header": header, "multiLine": multi_line, "mode": "PERMISSIVE",
               "columnPruning": False, "columnNameOfCorruptRecord": RECORD}
    rows = spark.read.options(**options).schema(whole).csv(path)
    # Fields are held against their types only where columns are asked for, and Spark does
    # not read the record alone; so the record is made to depend on every column.
    nothing = [F.substring(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")), 1, 0)
               for name in columns.names]
    record = F.when(F.col(RECORD).isNotNull(), F.concat(RECORD, *nothing))
    return rows.withColumn(RECORD, record)


def read_strings(spark: SparkSession, path: str, multi_line: bool = True,
                 lenient: bool = False) -> DataFrame:
    """All columns as text.  If ``lenient``, rows with too many or too few fields are left
    out, so that they have no say in what types the columns have."""
    strings = read_posts(spark, path, "csv", multi_line=multi_line)
    if not lenient:
        return strings
    records = read_records(spark, path, strings.schema, multi_line)
    return records.filter(F.col(RECORD).isNull()).drop(RECORD)


def quarantine_broken(records: DataFrame, path: str, mode: str = "errorifexists") -> tuple[DataFrame, Counts]:
    """Write the broken records with their files to ``path``; the good rows and how many
    rows there are of each, counted while they are written."""
    counts = Observation("csv_rows")
    broken = F.count(F.col(RECORD)).alias("broken")
    own = records.select("*", F.input_file_name().alias("file"))
    seen = own.observe(counts, F.count(F.lit(1)).alias("n_rows"), broken)
    write_parquet(seen.filter(F.col(RECORD).isNotNull()).select("file", RECORD), path, mode=mode)
    found = counts.get
    good = records.filter(F.col(RECORD).isNull()).drop(RECORD)
    return good, Counts(found["n_rows"] - found["broken"], found["broken"])
