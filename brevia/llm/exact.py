"""Exact deduplication as a stateful stream.

Files of documents arrive and are read once each.  The stream keeps one entry of state for
each digest, on the executors' disks (RocksDB) and in the checkpoint, and never lets it
expire: how many rows had the digest, and of the row that stays its length, its stable
identifier and the locator of its content (file and row in the file).  What a batch has
changed is written under the batch's number, so a batch that is run again writes the
same rows to the same place.

A hit is a row whose digest the state knows already.  For hits the whole texts are
compared: each task sends one row for each content, so copies are no load.  Digests under
which contents differ are grouped anew by the contents themselves.

Texts are equal if they are the same after all blanks, tabs and line ends are removed.
Of equal texts the row with the longest original text stays, then that with the least
identifier, then the first by locator.  Only DataFrame functions are used; the state of a
folder is fixed to the number of shuffle partitions of its first run.

* Null text: the empty text, equal to all texts of white space.
* Null identifier: after all others; the rows are documents like any other.
* Repeated rows: each counts; exactly one row of a group is marked as kept, by its locator.
* An empty table: no rows.
* Columns beside the identifier and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import scratch_path
from .common import stored

BLANKS = r"[\x20\x09-\x0D]+"
# A micro-batch reads about so many bytes of files at most.
BATCH_BYTES = 256 << 30
# Digests of hits are sent to all tasks if they have so many bytes at most.
SENT_BYTES = 32 << 20
DIGEST_BYTES = 48
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Small changes are stored as changes, and all stores of an executor share one bound.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # No disk is set aside ahead of use, as there is a store for each shuffle partition.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


class Names(NamedTuple):
    """The columns, and how a content is digested."""

    key: str = "doc_id"
    text: str = "text"
    digest: Callable[[Column], Column] = lambda body: F.unhex(F.sha2(body, 256))


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def arrivals(docs: DataFrame, names: Names) -> DataFrame:
    """(digest, standing, body) of each row.  ``standing`` is least for the row that
    stays; it begins with the length and the identifier and ends with the locator."""
    key, text = F.col(names.key), F.col(names.text)
    body = content(text)
    standing = F.struct(
        (-F.coalesce(F.length(text), F.lit(0))).alias("rest"), key.isNull().alias("no_id"),
        key.alias("id"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return docs.select(names.digest(body).alias("digest"), standing.alias("standing"),
                       body.alias("body"))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with ``values`` set; afterwards as it was."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def take_in(spark: SparkSession, source: str, folder: str, names: Names = Names(),
            batch_bytes: int = BATCH_BYTES, max_files: int | None = None) -> None:
    """Read the Parquet files of ``source`` that are new to the state in ``folder``.

    ``folder`` must be on storage that outlives the executors.  A run that failed is taken
    up by the next one where it stopped.
    """
    limit = {"maxBytesPerTrigger": batch_bytes} if max_files is None else {"maxFilesPerTrigger": max_files}
    # As a pattern that matches this name alone, a source may be a single file as well.
    name = source.rstrip("/")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).options(**limit).parquet(
        f"{name[:-1]}[{name[-1]}]")
    state = arrivals(stream, names).groupBy("digest").agg(
        F.min("standing").alias("first"), F.count(F.lit(1)).alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/groups/batch={batch}")

    with settings(spark, STATE):
        query = (state.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()


def groups(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, first, group_size) as the state has them: of each digest the last change,
    which is that with most rows."""
    every = spark.read.parquet(f"{folder}/groups")
    last = F.max_by(F.struct("first", "group_size"), "batch").alias("last")
    return every.groupBy("digest").agg(last).select("digest", "last.first", "last.group_size")


def unlike(docs: DataFrame, hits: DataFrame, names: Names, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(digest) of those among the hits under which whole contents differ.

    The hits' digests pick the rows whose contents are compared, if they are small enough
    to be sent to all tasks; if not, the contents of all rows are compared, which moves
    each content once for a task and needs no join.
    """
    rows = arrivals(docs, names).select("digest", "body")
    if hits.count() * DIGEST_BYTES <= sent_bytes:
        rows = rows.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    contents = rows.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    return contents.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")


def members(docs: DataFrame, known: DataFrame, names: Names = Names(),
            sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, digest, text_sha256) of each row of ``docs``.

    Rows are joined with the groups of two and more alone; any other row stays.
    """
    hits = stored(known.filter("group_size > 1"), "hits")
    differing = stored(unlike(docs, hits, names, sent_bytes), "unlike")
    rows = arrivals(docs, names).select(
        "digest", "standing", F.sha2("body", 256).alias("text_sha256"), "body")

    def result(joined: DataFrame) -> DataFrame:
        first = F.coalesce("first", "standing")
        return joined.select(
            F.col("standing.id").alias("id"), first["id"].alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (first == F.col("standing")).alias("kept"), "digest", "text_sha256")

    if differing.isEmpty():
        return result(rows.drop("body").join(hits, "digest", "left"))
    # Digests are no proof here: these rows are grouped by their whole contents.
    same = result(rows.drop("body").join(differing, "digest", "left_anti").join(hits, "digest", "left"))
    other = rows.join(differing, "digest", "left_semi")
    by_content = other.groupBy("digest", "body").agg(
        F.min("standing").alias("first"), F.count(F.lit(1)).alias("group_size"))
    return same.unionByName(result(other.join(by_content, ["digest", "body"])))


def deduplicated(spark: SparkSession, source: str, folder: str, names: Names = Names(),
                 batch_bytes: int = BATCH_BYTES, max_files: int | None = None) -> DataFrame:
    """Take in what is new in ``source`` and tell of each of its rows whether it stays."""
    take_in(spark, source, folder, names, batch_bytes, max_files)
    return members(spark.read.parquet(source), groups(spark, folder), names)


def q_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(spark, f"{sf_dir}/documents.parquet", scratch_path(spark, "exact"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")
