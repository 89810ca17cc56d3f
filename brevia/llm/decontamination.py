"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may occur with up to e errors (inserted, deleted or replaced
characters).  If it is cut into e + 1 pieces, one of them at least occurs unchanged.  All
pieces go into one automaton, every document is streamed through it, and around each hit
the item's edit distance to the text is found with Myers' bit-parallel algorithm.

Items and documents are compared in lower case with single blanks between words.  The
error budget is ERROR_RATE of an item's characters, and at most one for each LEAST_PIECE
characters less one, so that no piece is shorter than that.  An item of fewer than
LEAST_ITEM characters occurs by chance in text that has nothing to do with it; it is never
found (``least`` changes that).

* Null or blank item: never found.  Null or blank document: holds no item.
* Null or text ids of items: kept as they are.
* Repeated items or documents: each row counts on its own; an item's text is sent once.
* An empty table of documents or items: nothing is found.
* Columns beside id and text are kept by ``without_contaminated`` and not read by
  ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import table

ERROR_RATE = 0.08
LEAST_PIECE = 10
LEAST_ITEM = 20
ITEM_BLOCK_BYTES = 4 << 20


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


class Pattern:
    """An item with its error budget, pieces and bit masks."""

    def __init__(self, item_id: int | str | None, text: str, rate: float):
        self.item_id, self.text, self.n = item_id, text, len(text)
        self.errors = max(0, min(int(rate * self.n), self.n // LEAST_PIECE - 1))
        cuts = [self.n * k // (self.errors + 1) for k in range(self.errors + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.masks: dict[str, int] = {}
        for at, char in enumerate(text):
            self.masks[char] = self.masks.get(char, 0) | 1 << at

    def nearest(self, text: str) -> tuple[int, int]:
        """The least edit distance to any part of ``text`` and where that part ends:
        Myers' algorithm with a whole column of the table in one integer."""
        full, top = (1 << self.n) - 1, 1 << self.n - 1
        plus, minus, score = full, 0, self.n
        best, where = self.n, 0
        masks = self.masks
        for at, char in enumerate(text, 1):
            equal = masks.get(char, 0)
            vertical = equal | minus
            horizontal = ((equal & plus) + plus ^ plus) | equal
            up = minus | full & ~(horizontal | plus)
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1, down << 1
            plus = full & (down | ~(vertical | up))
            minus = up & vertical & full
            if score < best:
                best, where = score, at
        return best, where


class Hit(NamedTuple):
    item_id: int | str | None
    distance: int
    end: int  # in the document's plain form


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | str | None, str]], rate: float = ERROR_RATE,
                 least: int = LEAST_ITEM):
        self.patterns = [Pattern(i, t, rate) for i, t in ((i, plain(t)) for i, t in items)
                         if len(t) >= max(1, least)]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, pattern in enumerate(self.patterns):
            for at, piece in pattern.pieces:
                owners.setdefault(piece, []).append((number, at + len(piece)))
        for piece, found in owners.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[Hit]:
        line = plain(text)
        if not line or not self.patterns:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        for end, found in self.automaton.iter(line):
            for number, offset in found:
                pattern = self.patterns[number]
                begin = end + 1 - offset - pattern.errors
                span = max(0, begin), begin + pattern.n + 2 * pattern.errors
                known = spans.setdefault(number, [])
                if known and span[0] <= known[-1][1]:
                    known[-1] = min(known[-1][0], span[0]), max(known[-1][1], span[1])
                else:
                    known.append(span)
        out = []
        for number, known in spans.items():
            pattern = self.patterns[number]
            near = min((*pattern.nearest(line[a:b]), a) for a, b in known)
            if near[0] <= pattern.errors:
                out.append(Hit(pattern.item_id, near[0], near[2] + near[1]))
        return sorted(out, key=lambda hit: (hit.distance, hit.end))


def distinct_items(items: DataFrame, item_text: str) -> DataFrame:
    """(item, text): each text once, with a digest to find its rows again."""
    texts = items.select(F.col(item_text).alias("text")).filter("text IS NOT NULL").distinct()
    return texts.select(F.sha2("text", 256).alias("item"), "text")


def item_blocks(items: DataFrame, key: str, text: str,
                block_bytes: int = ITEM_BLOCK_BYTES) -> Iterator[list[tuple[int | str | None, str]]]:
    """The items in blocks of bounded size; each is a pass over the documents."""
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64(text), F.lit(blocks)) == block)
        yield [(row[0], row[1]) for row in part.select(key, text).collect()]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
            item_key: str = "item_id", item_text: str = "text",
            rate: float = ERROR_RATE, least: int = LEAST_ITEM) -> DataFrame:
    """(doc_id, item_id, distance, end) of each item found in a document; ids keep the
    types they have.  Rows of items with one text are joined with the hits of that text."""
    schema = StructType([StructField("found_in", docs.schema[key].dataType),
                         StructField("item", StringType()), StructField("distance", IntegerType()),
                         StructField("end", IntegerType())])
    hits = docs.sparkSession.range(0).select(
        *(F.lit(None).cast(part.dataType).alias(part.name) for part in schema))
    for block in item_blocks(distinct_items(items, item_text), "item", "text"):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, least)
            for batch in batches:
                rows = [(key_, *hit) for key_, value in zip(batch.column(0).to_pylist(), batch.column(1))
                        for hit in matcher(value.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                        (batch.column(0).type, pa.string(), pa.int32(), pa.int32()))],
                    ["found_in", "item", "distance", "end"])

        hits = hits.unionByName(docs.select(key, text).mapInArrow(run, schema))
    named = items.select(F.col(item_key).alias("item_id"), F.sha2(F.col(item_text), 256).alias("item"))
    return hits.join(named, "item").select(F.col("found_in").alias(key), "item_id", "distance", "end")


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                         item_key: str = "item_id", item_text: str = "text",
                         rate: float = ERROR_RATE, least: int = LEAST_ITEM) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    place = docs.columns.index(text)
    for block in item_blocks(distinct_items(items, item_text), "item", "text"):
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not matcher(v.as_py()) for v in batch.column(place)],
                                            pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def q_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
