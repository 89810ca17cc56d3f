"""The bulk cleaning job: every column kept, the cleaned text added."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import (
    handle_emojis, normalize_hashtags, remove_mentions, replace_urls, strip, to_lowercase,
)
from ..functions.emoji_names import EmojiNames, default_names
from ..functions.patterns import CLEAN_SUFFIX
from ..sources.checked_csv import (
    Counts, lossless_schema, quarantine_broken, read_records, read_strings,
)
from ..sources.readers import detect_format, read_posts, require_text_column
from ..sources.writers import write_parquet


_MARKED = "__marked"
# The pattern rules and a mark without which a text cannot match.
MARKED_RULES = (("://", replace_urls), ("@", remove_mentions), ("#", normalize_hashtags))


@lru_cache(maxsize=4)
def _cleaned_marked(application: str, names: EmojiNames) -> Column:
    """The last steps over the marked-up text; kept, as building them takes a while."""
    return to_lowercase(handle_emojis(F.col(_MARKED), names))


def clean_posts(
    df: DataFrame, text_col: str = "text", output_col: str | None = None,
    names: EmojiNames | None = None,
) -> DataFrame:
    """Add the cleaned text; a narrow step without shuffle or Python worker.

    Each pattern rule has a projection of its own inside one span of generated code
    and runs only on texts with its mark; the emoji step, which looks at its input
    more than once, comes after them.  Stripping first is the same as stripping
    after the addresses, since these hold no white space.
    """
    require_text_column(df, text_col)
    spark = df.sparkSession
    cleaned = _cleaned_marked(spark.sparkContext.applicationId, names or default_names(spark))
    marked = F.col(_MARKED)
    df = df.withColumn(_MARKED, strip(F.coalesce(F.col(text_col), F.lit(""))))
    for mark, rule in MARKED_RULES:
        df = df.withColumn(_MARKED, F.when(marked.contains(mark), rule(marked)).otherwise(marked))
    return df.withColumn(output_col or text_col + CLEAN_SUFFIX, cleaned).drop(_MARKED)


def clean_file(
    spark: SparkSession, source: str, target: str, text_col: str = "text",
    mode: str = "errorifexists", schema: T.StructType | str | None = None, multi_line: bool = True,
    quarantine: str | None = None,
) -> Counts | None:
    """Read CSV or Parquet, clean one column, write Parquet.

    All columns stay as they are, in the order of the rows.  Without a ``schema`` a first
    scan finds types of a CSV file that give back every value's text.  CSV rows that do not
    fit the table end the job, or are written to ``quarantine`` if that is given; then
    the numbers of good and broken rows are returned.
    """
    csv = detect_format(source) == "csv"
    if csv and schema is None:
        strings = read_strings(spark, source, multi_line, lenient=quarantine is not None)
        schema = lossless_schema(require_text_column(strings, text_col), keep=(text_col,))
    counts = None
    if csv and quarantine is not None:
        records = read_records(spark, source, schema, multi_line)
        posts, counts = quarantine_broken(records, quarantine, mode)
    else:
        posts = read_posts(spark, source, schema=schema, multi_line=multi_line)
    write_parquet(clean_posts(require_text_column(posts, text_col), text_col), target, mode=mode)
    return counts
