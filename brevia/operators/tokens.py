"""Vocabulary and fixed-length encoding of posts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# Reserved entries ahead of the learned tokens, default row length.
SPECIAL_TOKENS = ("<s>", "<pad>", "</s>", "<unk>")
BOS, PAD, EOS, UNK = range(len(SPECIAL_TOKENS))
MAX_LENGTH = 128

# The vocabulary has at most this many rows and bytes, as every executor holds it.
MOST_TOKENS = 1_000_000
MOST_BYTES = 64 << 20


def token_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each token occurs, with a partial count per task, so that frequent
    tokens do not burden one reducer."""
    return (
        df.select(F.explode(tokens(F.col(text_col))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("n"))
    )


def build_vocabulary(df: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """The ``size`` most frequent tokens with ids after the reserved ones.

    Ties are broken by the token.  The number of tokens of each frequency gives the
    lowest frequency that can be in the result; rarer tokens are dropped where they
    are, and only the rest is ordered and numbered in one task.  Both readings of
    the frequencies share one shuffle.
    """
    counts = token_frequencies(df, text_col)
    reached = F.sum("tokens").over(Window.orderBy(F.desc("n")))
    lowest = (
        counts.groupBy("n").agg(F.count("*").alias("tokens"))
        .select("n", reached.alias("reached"))
        .agg(F.coalesce(F.max(F.when(F.col("reached") >= size, F.col("n"))), F.lit(0)))
    )
    order = [F.desc("n"), F.asc("token")]
    top = counts.filter(F.col("n") >= lowest.scalar()).orderBy(*order).limit(size)
    position = F.row_number().over(Window.orderBy(*order))
    return top.select("token", "n", (position + len(SPECIAL_TOKENS) - 1).alias("token_id"))


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Store the vocabulary, so that later encodings do not count the tokens again."""
    vocabulary.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _framed(ids: Column, max_length: int) -> Column:
    body = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    return F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(body)))


def _mask(n_ids: Column, max_length: int) -> Column:
    used = n_ids + 2
    return F.concat(
        F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used)
    )


def _lookup(listed: list[str], spark):
    """Token ids of token lists; the hash table is built once for each task."""
    shared = spark.sparkContext.broadcast(listed)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = dict(zip(shared.value, range(len(SPECIAL_TOKENS), len(shared.value) + len(SPECIAL_TOKENS))))
        for batch in batches:
            # Lists of null rows are empty, so offsets and values stay aligned.
            numbers = [known.get(token, UNK) for token in batch.flatten().to_pylist()]
            lengths = pc.fill_null(pc.list_value_length(batch), 0)
            ends = pc.cumulative_sum(lengths.cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32()))

    return ids


def encode(
    df: DataFrame, vocabulary: DataFrame, max_length: int = MAX_LENGTH, text_col: str = "text",
) -> DataFrame:
    """Replace the text by ``input_ids`` and ``attention_mask`` of length ``max_length``.

    Rows are cut to ``max_length`` including the two frame tokens, and padded.  Each row
    is encoded on its own in one narrow step, whatever the vocabulary's size; a
    vocabulary beyond ``MOST_TOKENS`` or ``MOST_BYTES``, which are measured first, is
    refused, as executors could not hold it.  It is read more than once, so pass a
    stored one.
    """
    n_tokens, n_bytes = vocabulary.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))
    ).first()
    if n_tokens > MOST_TOKENS or n_bytes > MOST_BYTES:
        raise ValueError(f"vocabulary of {n_tokens} tokens, {n_bytes} bytes; at most"
                         f" {MOST_TOKENS} and {MOST_BYTES} can be sent to executors")
    listed = sorted(map(tuple, vocabulary.select("token_id", "token").collect()))
    if [i for i, _ in listed] != [len(SPECIAL_TOKENS) + k for k in range(len(listed))]:
        raise ValueError("token ids must follow the reserved ones without gaps")
    cut = F.slice(tokens(F.col(text_col)), 1, max_length - 2)
    ids = _lookup([token for _, token in listed], df.sparkSession)
    return df.withColumn("__ids", ids(cut)).withColumns({
        "input_ids": _framed(F.col("__ids"), max_length),
        "attention_mask": _mask(F.size("__ids"), max_length),
    }).drop(text_col, "__ids")
