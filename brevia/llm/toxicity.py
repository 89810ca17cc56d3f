"""Toxicity by classifier chains.

The labelled categories stand in a fixed order.  A logistic regression on the words of a
text predicts the first; each later one also gets the probabilities of those before it.
In training these come from models that have not seen the row (out of fold), as the
probabilities of new texts do.

* Null or empty text: judged on no words.
* Labels that are null count as "no".  Without any labels, or if a category has one value
  only, its probability is that value (0 without labels).
* Repeated rows are answered one by one; ties at the threshold count as toxic.
* An empty table: no rows.
* Columns beside key, text and labels are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .features import SAMPLE_ROWS, hashed, labelled_sample, words_of

# Each category by an expression over the labels; later ones see the earlier ones.
CATEGORIES = {
    "low_quality": "quality = 0",
    "toxic": "toxic = 1",
    "toxic_low_quality": "toxic = 1 AND quality = 0",
}
FOLDS = 3


class Link(NamedTuple):
    """One category's model, or the only value that it has."""

    category: str
    model: LogisticRegressionModel | None
    value: float


def _levels(chance: str) -> Column:
    """A probability as tokens, one for each tenth that it reaches."""
    steps = F.sequence(F.lit(1), F.floor(F.col(chance) * 10).cast("int"))
    named = F.transform(steps, lambda step: F.concat(F.lit(f"{chance} >= "), step))
    return F.when(F.col(chance) >= 0.1, named).otherwise(F.expr("CAST(array() AS array<string>)"))


def _fit(rows: DataFrame, category: str) -> Link:
    """The category's model on the tokens of ``rows``."""
    counts = {r[0]: r[1] for r in rows.groupBy(category).count().collect()}
    if len(counts) < 2:
        return Link(category, None, float(next(iter(counts), 0.0)))
    model = LogisticRegression(
        featuresCol="chain", labelCol=category, regParam=2e-3, elasticNetParam=1.0, maxIter=25,
        probabilityCol="chain_p", rawPredictionCol="chain_r", predictionCol="chain_y",
    ).fit(hashed("tokens", "chain").transform(rows))
    return Link(category, model, 0.0)


def _with_chance(rows: DataFrame, link: Link) -> DataFrame:
    """Adds the probability of the link's category, and its levels to the tokens."""
    name = f"p_{link.category}"
    if link.model is None:
        scored = rows.withColumn(name, F.lit(link.value))
    else:
        scored = link.model.transform(hashed("tokens", "chain").transform(rows)).withColumn(
            name, vector_to_array("chain_p")[1]).drop("chain", "chain_p", "chain_r", "chain_y")
    return scored.withColumn("tokens", F.concat("tokens", _levels(name)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          rows: int = SAMPLE_ROWS, categories: dict[str, str] = CATEGORIES) -> list[Link]:
    """The chain, fitted on about ``rows`` labelled documents at most."""
    sample = labelled_sample(docs, labels, key, text, rows)
    marks = (F.coalesce(F.expr(e), F.lit(False)).cast("double").alias(c)
             for c, e in categories.items())
    fold = F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(FOLDS)).cast("int")
    known = stored(sample.select(key, words_of(F.col("text")).alias("tokens"), fold.alias("fold"),
                                 *marks), "toxic-sample")
    chain = []
    for category in categories:
        chain.append(_fit(known, category))
        if len(chain) < len(categories):
            parts = (
                _with_chance(known.filter(F.col("fold") == part),
                             _fit(known.filter(F.col("fold") != part), category))
                for part in range(FOLDS)
            )
            known = stored(reduce(DataFrame.unionByName, parts), "toxic-folds")
    return chain


def predict(docs: DataFrame, chain: list[Link], key: str = "doc_id", text: str = "text",
            least: float = 0.5) -> DataFrame:
    """(key, p_category of each, is_toxic) of every row, in one pass without a shuffle."""
    out = docs.select(key, words_of(F.col(text)).alias("tokens"))
    for link in chain:
        out = _with_chance(out, link)
    return out.select(key, *(f"p_{link.category}" for link in chain),
                      (F.col("p_toxic") >= least).alias("is_toxic"))


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))
