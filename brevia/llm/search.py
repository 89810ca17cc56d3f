"""Ranked lexical search with deduplication of bags of terms.

A document is scored by how often it holds the items' terms and by its length, so all
that matters of it is its bag: the counts of terms in the items' vocabulary, and m, the
length penalty.  Documents with one bag form a class, met by the bag's hash and verified
on the whole bag.  Each class is scored once.  An item's best documents are found among
its best classes, in the order of score and least id, and each chosen class is expanded
into its members by ascending id.

Every document counts for the corpus statistics and takes part for every item.  A task
that scores classes keeps the best ``top`` of each item only; the ``top`` first classes of
an item hold its ``top`` first documents, as each class before a document's has a member
that comes before it.

Items are worked off in blocks of bounded size; a block's vocabulary and the list of the
items of each term are sent to the tasks.

* Null or termless text: counts for nothing and is never found.
* Null item text: finds nothing.  Rows with one item id and one text: one item.
* Ties: by ascending id; rows without an id come last.  Ids are whole numbers.
* Repeated rows: documents of their own, each with a rank.
* An empty table of documents or items: no rows.
* Columns beside ids and texts are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TOP = 10
# The penalty of a document's length: 100 - SLOPE for none, 100 at the mean length.
SLOPE = 75
ITEM_BLOCK_BYTES = 1 << 20
# Scores (classes by items) and single gains that a task holds at a time.
SCORES_AT_ONCE = 1 << 22
GAINS_AT_ONCE = 1 << 21
_LAST = np.iinfo(np.int64).max
# Letters A to Z in lower case, other ASCII letters and digits as they are, the rest a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32
               for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode().translate(_PLAIN).split() if text else []


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def bags(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms, counts): the number of all terms, and of those in the
    vocabulary the places, ascending, with their counts.  A narrow step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, places, counts = [], [], []
            for value in batch.column(1):
                own = terms(value.as_py())
                seen = Counter(own)
                found = sorted((vocabulary[t], seen[t]) for t in seen.keys() & vocabulary.keys())
                lengths.append(len(own))
                pairs = np.array(found, np.int64).reshape(-1, 2)
                places.append(pairs[:, 0])
                counts.append(pairs[:, 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), lists(places, pa.int32()),
                 lists(counts, pa.int32())], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(
        run, "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, counts ARRAY<INT>")


def same_bag(found: DataFrame, n_docs: int, n_terms: int) -> list[Column]:
    """What makes a class: the bag's hash, and the bag itself, which verifies it."""
    m = F.expr(f"{100 - SLOPE} + ({SLOPE} * n * {n_docs}L) div {max(1, n_terms)}L")
    return [F.xxhash64("terms", "counts", m).alias("bag_hash"), F.col("terms"), F.col("counts"),
            m.alias("m")]


class Scorer:
    """Scores of classes for the items of a block; keeps each item's best."""

    def __init__(self, weights: np.ndarray, postings: list[np.ndarray], times: list[np.ndarray],
                 n_items: int, top: int):
        self.weights, self.n_items, self.top = weights, n_items, top
        self.ends = np.cumsum([0, *map(len, postings)])
        self.items = np.concatenate([*postings, np.empty(0, np.int64)]).astype(np.int64)
        self.times = np.concatenate([*times, np.empty(0, np.int64)]).astype(np.int64)
        # By item: (-score, least id, the class's row) of the best, and what to beat.
        self.best: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)

    def scores(self, sizes: np.ndarray, places: np.ndarray, counts: np.ndarray,
               m: np.ndarray) -> np.ndarray:
        """Of every class (rows) for every item; all in whole numbers."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        gain = self.weights[places] * (1_000_000_000 * counts // (1000 * counts + 8 * m[owner]))
        begin, n = self.ends[places], self.ends[places + 1] - self.ends[places]
        out = np.zeros(len(sizes) * self.n_items, np.int64)
        total = np.cumsum(n)
        cuts = np.searchsorted(total, np.arange(GAINS_AT_ONCE, n.sum(), GAINS_AT_ONCE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
            # Each term of a class meets the items that hold it.
            some = n[a:b]
            which = np.repeat(np.arange(a, b), some)
            at = np.arange(len(which)) - np.repeat(np.cumsum(some) - some, some) + begin[which]
            np.add.at(out, owner[which] * self.n_items + self.items[at],
                      gain[which] * self.times[at])
        return out.reshape(len(sizes), self.n_items)

    def add(self, scores: np.ndarray, first: np.ndarray, row) -> None:
        """Keep the best of these classes; ``row(k)`` gives what to return of one."""
        better = scores >= self.least
        for item in np.flatnonzero(better.any(axis=0)).tolist():
            rows = np.flatnonzero(better[:, item])
            order = np.lexsort((first[rows], -scores[rows, item]))[:self.top]
            fresh = [(-int(scores[k, item]), int(first[k]), row(k)) for k in rows[order].tolist()]
            kept = sorted(self.best[item] + fresh, key=lambda c: c[:2])[:self.top]
            self.best[item] = kept
            if len(kept) == self.top:
                self.least[item] = -kept[-1][0]


def best_classes(classes: DataFrame, scorer: dict, top: int) -> DataFrame:
    """(item, score, first_id, bag_hash, terms, counts, m): each task's best of an item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Scorer(**scorer, top=top)
        rows_at_once = max(1, SCORES_AT_ONCE // work.n_items)
        for whole in batches:
            for part in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(part, rows_at_once)
                col = dict(zip(batch.schema.names, batch.columns))
                places = col["terms"].flatten().to_numpy().astype(np.int64)
                sizes = col["terms"].value_lengths().to_numpy().astype(np.int64)
                first = col["first_id"].fill_null(_LAST).to_numpy(zero_copy_only=False)
                found = work.scores(sizes, places, col["counts"].flatten().to_numpy().astype(np.int64),
                                    col["m"].to_numpy())
                work.add(found, first, lambda k, b=batch: b.slice(k, 1).to_pylist()[0])
        rows = [{"item": item, "score": -score, **row}
                for item, kept in enumerate(work.best) for score, _, row in kept]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("item", pa.int32()), ("score", pa.int64()), ("first_id", pa.int64()),
             ("bag_hash", pa.int64()), ("terms", pa.list_(pa.int32())),
             ("counts", pa.list_(pa.int32())), ("m", pa.int64())]))

    return classes.select("first_id", "bag_hash", "terms", "counts", "m").mapInArrow(
        run, "item INT, score BIGINT, first_id BIGINT, bag_hash BIGINT, terms ARRAY<INT>,"
             " counts ARRAY<INT>, m BIGINT")


def first_rows(df: DataFrame, by: list[str], order: list[Column], top: int, name: str) -> DataFrame:
    """The ``top`` first rows of each group, numbered from 1; tasks drop the others
    before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col(name) <= top)


def search_block(docs: DataFrame, block: list[tuple[int, str]], key: str, text: str,
                 top: int) -> DataFrame:
    """(item, rank, doc_id, score) for the items of one block, by their numbers."""
    vocabulary: dict[bytes, int] = {}
    holders: list[dict[int, int]] = []
    for item, (_, value) in enumerate(block):
        for term, times in Counter(terms(value)).items():
            place = vocabulary.setdefault(term, len(vocabulary))
            if place == len(holders):
                holders.append({})
            holders[place][item] = times
    found = stored(bags(docs, vocabulary, key, text), "bags")
    n_docs, n_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    held = found.select(F.explode("terms").alias("term")).groupBy("term").count()
    for term, df in held.collect():  # one row for each term of the block at most
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    scorer = {
        "weights": weights, "n_items": len(block),
        "postings": [np.fromiter(h, np.int64, len(h)) for h in holders],
        "times": [np.fromiter(h.values(), np.int64, len(h)) for h in holders],
    }
    # Whether documents share a bag is counted in each task before rows are sent.
    bag = same_bag(found, n_docs, n_terms)
    members = found.filter(F.size("terms") > 0).select("doc_id", *bag)
    whole = ["bag_hash", "terms", "counts", "m"]
    classes = members.groupBy(*whole).agg(F.min("doc_id").alias("first_id"))
    by_score = [F.col("score").desc(), F.col("first_id").asc_nulls_last()]
    chosen = stored(first_rows(best_classes(classes, scorer, top), ["item"], by_score, top, "place"),
                    "best-classes")
    # At most ``top`` hashes for each item of a block are sent; they leave few members, of
    # which tasks keep the first ones of each class.  The join verifies the whole bags.
    wanted = F.broadcast(chosen.select("bag_hash").distinct())
    expanded = first_rows(members.join(wanted, "bag_hash", "left_semi"), whole,
                          [F.col("doc_id").asc_nulls_last()], top, "member")
    rows = chosen.join(expanded, whole).select("item", "score", "doc_id")
    ranked = first_rows(rows, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()],
                        top, "rank")
    return ranked.select("item", "rank", "doc_id", "score")


def item_blocks(items: DataFrame, key: str, text: str,
                block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """The distinct items in blocks, dealt by hash; the number of blocks follows from the
    bytes of the items, so that a block is of bounded size."""
    own = items.select(F.col(key).alias("item_id"), F.col(text).alias("text")).filter(
        "text IS NOT NULL").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [tuple(row) for row in part.collect()]


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", top: int = TOP,
           block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``top`` documents."""
    spark, kind = docs.sparkSession, items.schema[item_key].dataType
    out = spark.createDataFrame([], "item_id STRING, rank INT, doc_id BIGINT, score BIGINT").withColumn(
        "item_id", F.col("item_id").cast(kind))
    for block in item_blocks(items, item_key, item_text, block_bytes):
        names = spark.createDataFrame([(k, row[0]) for k, row in enumerate(block)],
                                      f"item INT, item_id {kind.simpleString()}")
        found = search_block(docs, block, key, text, top)
        out = out.unionByName(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
