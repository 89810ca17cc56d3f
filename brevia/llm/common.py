"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import scratch_path

# A word: what stands between blanks, tabs and line ends (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again, which cuts its
    lineage: a lost executor costs a read, not the work before it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null.  ``bytes.split`` cuts at exactly
    the characters that WORD leaves out."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  They are computed anew each time, which takes less than
    looking them up among those of a large vocabulary, and no memory."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit values."""
    with np.errstate(over="ignore"):
        v = values ^ (values >> np.uint64(30))
        v = v * np.uint64(0xBF58476D1CE4E5B9)
        v = v ^ (v >> np.uint64(27))
        v = v * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of ``size`` words, in order; none for shorter texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * ODD + words[k:k + n]
            out ^= out >> np.uint64(29)
    return mixed(out)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def crc32(column: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores, so that ``df`` has no such column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_columns(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, which may hold dots."""
    return [F.col(f"`{name}`") for name in names]
