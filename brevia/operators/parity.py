"""Comparison of two outputs row by row, matched on a key or by their places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import mismatch_preview
from ..sources.positions import INDEX, with_row_index

_DIFFERS = "n_left <> n_right"


def value_balance(
    left: DataFrame, right: DataFrame, value_col: str, id_col: str = "id", shown: bool = False
) -> DataFrame:
    """How many rows each side has of every (key, value).

    Both sides are stacked and counted instead of joined: one shuffle, hash
    aggregation with a partial count, and a key repeated on both sides cannot
    multiply.  A SHA-256 digest stands for the value, with its beginning if it is to be
    shown, so whole texts are not shuffled.  A null value or key counts as one.
    """
    by = ["id", "digest", *["shown"] * shown]

    def side(df: DataFrame, n_left: int, n_right: int) -> DataFrame:
        value = F.col(value_col)
        return df.select(
            F.col(id_col).alias("id"), F.unhex(F.sha2(value, 256)).alias("digest"),
            *[mismatch_preview(value).alias("shown")] * shown,
            F.lit(n_left).alias("l"), F.lit(n_right).alias("r"),
        )

    return (
        side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*by)
        .agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    )


def parity_check(left: DataFrame, right: DataFrame, value_col: str, id_col: str = "id") -> DataFrame:
    """(n_left, n_right, all_match, mismatch_count); with unequal row counts the
    mismatches are the difference of the counts, else the keys that differ, of which
    null is one."""
    def total(column: str):
        return F.coalesce(F.sum(column), F.lit(0)).alias(column)

    keys = value_balance(left, right, value_col, id_col).groupBy("id").agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"),
        F.max(F.expr(_DIFFERS).cast("int")).alias("differs"),
    )
    totals = keys.agg(total("n_left"), total("n_right"), total("differs"))
    gap = F.abs(F.col("n_left") - F.col("n_right"))
    mismatches = F.when(gap > 0, gap).otherwise(F.col("differs"))
    return totals.select(
        "n_left", "n_right", (mismatches == 0).alias("all_match"),
        mismatches.alias("mismatch_count"),
    )


def parity_mismatches(
    left: DataFrame, right: DataFrame, value_col: str, n: int = 3, id_col: str = "id"
) -> DataFrame:
    """The first ``n`` differing keys, null first, with the beginning of both values.

    The keys are found by digests; only their rows are read again to be shown.
    """
    found = value_balance(left, right, value_col, id_col).filter(_DIFFERS).select(
        "id").distinct().orderBy("id").limit(n).withColumnRenamed("id", "__key")

    def rows(df: DataFrame) -> DataFrame:
        same = F.col(id_col).eqNullSafe(F.col("__key"))
        return df.join(F.broadcast(found), same, "left_semi")  # n rows

    def text(more: str, less: str):
        return F.min(F.when(F.col(more) > F.col(less), F.col("shown")))

    return (
        value_balance(rows(left), rows(right), value_col, id_col, shown=True)
        .filter(_DIFFERS)
        .groupBy("id")
        .agg(text("n_left", "n_right").alias("left_text"),
             text("n_right", "n_left").alias("right_text"))
        .orderBy("id")
    )


def parity_by_position(left: DataFrame, right: DataFrame, value_col: str,
                       fmt: str = "parquet") -> DataFrame:
    """As :func:`parity_check` for two stored outputs without a key: their n-th rows, in the
    order of files and of rows in a file, are compared.

    Rows are counted first; outputs of unequal length are not read any further.
    """
    n_left, n_right = left.count(), right.count()
    if n_left != n_right:
        return left.sparkSession.createDataFrame(
            [(n_left, n_right, False, abs(n_left - n_right))],
            "n_left BIGINT, n_right BIGINT, all_match BOOLEAN, mismatch_count BIGINT")
    return parity_check(*_by_position(left, right, value_col, fmt), value_col, INDEX)


def position_mismatches(left: DataFrame, right: DataFrame, value_col: str, n: int = 3,
                        fmt: str = "parquet") -> DataFrame:
    """The first ``n`` places, from 0, at which stored outputs differ, with the beginning
    of both values; a place that one output lacks counts as differing."""
    found = parity_mismatches(*_by_position(left, right, value_col, fmt), value_col, n, INDEX)
    return found.withColumnRenamed("id", INDEX)


def _by_position(left: DataFrame, right: DataFrame, value_col: str, fmt: str) -> list[DataFrame]:
    return [with_row_index([df], fmt)[0].select(INDEX, value_col) for df in (left, right)]
