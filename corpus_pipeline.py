"""A corpus pipeline of five stages, each made of one operator.

Stages take (spark, docs, sf_dir) and return the documents that stay, with the columns
they came with; the last returns every document's shard.  ``run`` writes each stage's
result to the shared scratch folder and reads it again for the next one.

Null or empty texts go at the first stage, as they have no language.  A stage that gets
no documents returns none.

Stages that hand texts to Python set the session's Arrow batches to a few megabytes, so
that the memory of a task does not follow the length of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brevia.llm import decontamination, jaccard, language, mixing, sharding
from brevia.llm.common import as_columns, stored, table, unused

# Texts that are nearer to no language than this are not of a known language.
LEAST_SCORE = 0.05
SHARDS = 24
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
# Fixed SQL cannot express trained models; tests compare with brute force instead.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages that the corpus is labelled with."""
    small_batches(spark)
    learnt = language.profiles(docs.filter(~language.held_out(F.col("doc_id"))))
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = language.predict(docs, learnt, pred=pred, score=score)
    known = (F.col(pred) != language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)
    return found.filter(known).select(*as_columns(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    The ids that go are looked up, so documents are moved once.  Rows that share an id
    are one document: the first text by order stays.  Rows without an id stay.
    """
    small_batches(spark)
    found = jaccard.jaccard_components(docs, jaccard.Likeness(5, 4, 5))
    gone = found.filter("component_id < id").select(F.col("id").alias("doc_id")).distinct()
    first = unused(docs, "first")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").withColumn(
        first, place).filter(F.col(first) == 1)
    columns = as_columns(docs.columns)
    return kept.select(*columns).unionByName(docs.filter("doc_id IS NULL").select(*columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their domains ask for."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) of each row."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
