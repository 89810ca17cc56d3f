"""Word features and labelled samples for the linear models."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_columns

HASHED = 1 << 16
SAMPLE_ROWS = 20_000
# For each round and part a solver sends a sum as large as its model, and the driver takes
# them in; so the parts are few and do not follow the documents'.
SAMPLE_PARTS = 2
_MILLION = 1_000_000


def words_of(text: Column) -> Column:
    """The runs of letters of a text in lower case; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def hashed(tokens: str, output: str, dimensions: int = HASHED) -> HashingTF:
    """Which tokens there are, hashed into a sparse vector; nothing is learnt."""
    return HashingTF(inputCol=tokens, outputCol=output, binary=True, numFeatures=dimensions)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str,
                    rows: int = SAMPLE_ROWS) -> DataFrame:
    """The labels with their documents' texts, about ``rows`` of them at most.

    Rows are chosen by a hash of the key, the same ones in each run.  The chosen labels
    are few enough, by that bound, to be sent to all tasks, so documents are not shuffled.
    Of several labels for a key the least by the order of the other columns counts, nulls
    first, so each run takes the same one.  The rows come in SAMPLE_PARTS parts.
    """
    others = [c for c in labels.columns if c != key]
    usable = labels.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(*as_columns(others))).alias("label")).select(
        key, *(F.col("label")[c].alias(c) for c in others))
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_MILLION))
                           < int(share * _MILLION))
    texts = docs.select(key, F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), key).repartition(SAMPLE_PARTS)
