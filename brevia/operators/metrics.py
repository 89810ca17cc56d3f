"""Classification measures.

Everything is derived from counts by (label, prediction): one shuffle of at most
(classes x classes) rows per task, whatever the number of predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import LABEL_NAMES
from ..functions.text import argmax


def with_prediction(df: DataFrame, scores_col: str = "scores") -> DataFrame:
    return df.withColumn("pred", argmax(F.col(scores_col)))


def confusion_counts(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    return df.groupBy(
        F.col(label_col).cast("int").alias("label"), F.col(pred_col).cast("int").alias("pred")
    ).agg(F.count("*").alias("n"))


def _class_counts(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """Hits, true and predicted rows of every class seen in truth or prediction."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(zero)
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), n.alias("support"),
                 zero.alias("predicted")),
        F.struct(F.col("pred").alias("class"), zero.alias("tp"), zero.alias("support"),
                 n.alias("predicted")),
    )
    return (
        confusion_counts(df, label_col, pred_col)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*(F.sum(c).alias(c) for c in ("tp", "support", "predicted")))
    )


def _ratio(part, whole):
    """A quotient that is 0 where it is undefined."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return _class_counts(df, label_col, pred_col).select(
        "class", "tp", "support",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1_score"),
    )


def evaluate(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """One row with accuracy and macro F1 over the classes seen in truth or prediction."""
    return class_metrics(df, label_col, pred_col).agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("f1_score").alias("f1_macro")
    )


def compute_metrics(df: DataFrame, label_col: str = "label", scores_col: str = "scores") -> DataFrame:
    """:func:`evaluate` on the highest score of each row."""
    return evaluate(with_prediction(df, scores_col), label_col)


def confusion_matrix(
    df: DataFrame, label_col: str = "label", pred_col: str = "pred",
    classes: int = len(LABEL_NAMES),
) -> DataFrame:
    """Rows are true classes, columns predicted ones; classes without rows are listed too.

    A label or prediction that is none of the ``classes`` stops the job, as it would
    have no place in the table.
    """
    ids = range(classes)
    own = F.array(F.struct(F.col("label"), F.col("pred"), F.col("n")))
    spark = df.sparkSession
    empty = spark.range(classes).select(
        F.col("id").cast("int").alias("label"), F.lit(0).alias("pred"),
        F.lit(0).cast("long").alias("n"),
    )
    counts = confusion_counts(df, label_col, pred_col)
    for column in ("label", "pred"):
        wrong = F.raise_error(F.concat(F.lit(f"{column} is none of {classes} classes: "),
                                       F.coalesce(F.col(column).cast("string"), F.lit("null"))))
        known = F.coalesce(F.col(column).between(0, classes - 1), F.lit(False))
        counts = counts.withColumn(column, F.when(known, F.col(column)).otherwise(wrong))
    counts = counts.select(F.inline(own)).unionByName(empty)
    return counts.groupBy("label").agg(*(
        F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0)).alias(f"pred_{k}") for k in ids
    ))


def classification_report(
    df: DataFrame, label_col: str = "label", pred_col: str = "pred"
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and the two averages.

    A rollup over the few class rows gives the averages in the same pass.
    """
    measures = ("precision", "recall", "f1_score")
    support = F.sum("support")
    rolled = class_metrics(df, label_col, pred_col).rollup("class").agg(
        F.grouping("class").alias("is_total"), support.alias("support"),
        F.try_divide(F.sum("tp"), support).alias("accuracy"),
        *(F.avg(m).alias(m) for m in measures),
        *(F.try_divide(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
          for m in measures),
    )

    def row(name, precision, recall, f1):
        return F.struct(
            name.cast("string").alias("class"), precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"), f1.alias("f1_score"),
            F.col("support").alias("support"),
        )

    one = F.array(row(F.col("class"), *map(F.col, measures)))
    totals = F.array(
        row(F.lit("accuracy"), F.lit(None), F.lit(None), F.col("accuracy")),
        row(F.lit("macro avg"), *map(F.col, measures)),
        row(F.lit("weighted avg"), *(F.col(f"weighted_{m}") for m in measures)),
    )
    return rolled.select(F.inline(F.when(F.col("is_total") == 1, totals).otherwise(one)))
