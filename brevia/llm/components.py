"""Connected components of links between ids, as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b), label being the smallest id that
    can be reached.

    Each round takes the least label among an id's neighbours and then the label of
    that label, until nothing changes.  Minima are combined before they are sent, so an
    id with very many links is no load; every round is stored, so that a lost executor
    costs one round at most.
    """
    both = stored(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
                    .withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(
            F.min("label").alias("near"))
        stepped = labels.join(near, F.col("id") == F.col("a")).select(
            "id", "label", F.least("label", "near").alias("next"))
        ahead = labels.select(F.col("id").alias("next"), F.col("label").alias("ahead"))
        moved = stored(stepped.join(ahead, "next").select(
            "id", F.col("label").alias("before"), F.least("next", "ahead").alias("label")),
            "labels")
        labels = moved.select("id", "label")
        if moved.filter("before <> label").isEmpty():
            return labels
