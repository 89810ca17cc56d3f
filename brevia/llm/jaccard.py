"""Join of documents by the Jaccard similarity of their word n-grams, by parity sketches.

The shingles of a document are hashed into bits of a sketch, each hit flipping its bit.
Two sketches differ in no more bits than the sets differ in shingles, and for sets of
s and t shingles with a similarity of num/den or more that is
(s + t) * (den - num) / (den + num) at most.  A sketch has more pieces than that bound
D, so the sketches of a pair have equal pieces; if P pieces are used, P - D of them at
least.  Each document drops the P - D - 1 of its pieces that come first in an order by
how many bits are set and then by content.  The last of a pair's equal pieces in that
order cannot be among them on either side, so the D + 1 pieces that stay, its fullest
ones, are enough for every pair to meet.  Sizes fall into bands; a band fixes P.  A
document also takes part in the next band if partners can be that large.

A piece has 2 ** 64 bits, one for each hash, and is kept as the xor of its set bits'
hashes.  Short pieces would not do: two or three bits of 64 are the same for many sets
that have no shingle in common, and the pairs that meet so grow with the square of the
number of sets.

Pairs that meet are verified on the shingles themselves:

1. Documents with one set are a class and one node, however many they are.
2. In each bucket every node is compared with the bucket's first, unless the two are in
   one component already.
3. Of the pairs left over in a bucket those with both ends in one component need no
   comparison; all others are compared.

Before texts are fetched, two more parity sketches rule out pairs whose sketches differ in
more bits than linked sets could: one of fixed length, and for the pairs that are left one
with a bit or more for each shingle, as a short one tells nothing of large sets.  No pair
within a component is formed after step 2, and no bucket is capped.

* Null or wordless text: no shingles; its own component; linked with nothing.
* Fewer words than a shingle has: the words as one shingle.
* Repeated rows, or rows with one id: the same document.  Null id: linked with nothing.
* An empty table: no rows.
* Columns beside the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, signed, stored, table, window_hashes, word_hashes
from .components import components

BAND = 2.0
SPARE = 1.4
SKETCH_WORDS = 8
MEMBERS_A_TASK = 512


class Likeness(NamedTuple):
    """Shingles of ``size`` words; a similarity of ``num`` / ``den`` makes a link."""

    size: int = 5
    num: int = 4
    den: int = 5

    def difference(self, total: int) -> int:
        """Shingles by which two linked sets can differ that have ``total`` together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def partner(self, size: int) -> int:
        return size * self.den // self.num

    def linked(self, one: np.ndarray, other: np.ndarray) -> bool:
        if not len(one) or not len(other):
            return False
        both = len(np.intersect1d(one, other, assume_unique=True))
        return self.den * both >= self.num * (len(one) + len(other) - both)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes, in order; A-Z count as a-z."""
    words = word_hashes(text.encode().lower().split()) if text else np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words)) or 1))


def set_hash(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def small_sketch(values: np.ndarray) -> np.ndarray:
    """A parity sketch of one fixed length, to compare pairs by before they are formed."""
    bits = 64 * SKETCH_WORDS
    places = (values >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def long_sketch(values: np.ndarray) -> np.ndarray | None:
    """A parity sketch with a bit or more for each shingle; none if the small one has that.
    Its length is a power of two, so it is folded to half of that by one xor."""
    words = 1 << (max(1, len(values) - 1) // 64).bit_length()
    if words <= SKETCH_WORDS:
        return None
    bits = 64 * words
    places = (values >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def may_link_closely(like: Likeness, a: str = "a", b: str = "b") -> str:
    """SQL: the long sketches, if both sets have one, do not rule out a link.  Sets that
    may be linked have sketches of one length, or one of twice the other's."""
    def folded(one: str, other: str) -> str:
        half = f"CAST(size(long_{one}) / 2 AS INT)"
        return (f"IF(size(long_{one}) > size(long_{other}), zip_with(slice(long_{one}, 1, {half}),"
                f" slice(long_{one}, 1 + {half}, {half}), (x, y) -> x ^ y), long_{one})")

    apart = (f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0,"
             " (done, n) -> done + n)")
    return (f"long_{a} IS NULL OR long_{b} IS NULL OR"
            f" {apart} * {like.den + like.num} <= (n_{a} + n_{b}) * {like.den - like.num}")


def may_link(like: Likeness, a: str = "a", b: str = "b") -> str:
    """SQL: neither the sizes nor the small sketches of two sets rule out a link."""
    apart = " + ".join(f"bit_count(sketch_{a}[{k}] ^ sketch_{b}[{k}])" for k in range(SKETCH_WORDS))
    return (f"{like.den} * least(n_{a}, n_{b}) >= {like.num} * greatest(n_{a}, n_{b}) AND"
            f" ({apart}) * {like.den + like.num} <= (n_{a} + n_{b}) * {like.den - like.num}")


def bands(most: int = 1 << 40) -> list[int]:
    """The largest size of each band."""
    out = [4]
    while out[-1] < most:
        out.append(int(out[-1] * BAND))
    return out


BANDS = bands()


def piece_keys(values: np.ndarray, like: Likeness) -> np.ndarray:
    """The keys under which a set, given in order, meets all its possible partners."""
    size, most, hashes = len(values), like.partner(len(values)), mixed(values)
    own = int(np.searchsorted(BANDS, size))
    out = [np.empty(0, np.uint64)]
    for band in (own, own + 1):
        if band > own and most <= BANDS[own]:
            break
        errors = like.difference(size + min(most, BANDS[band]))
        if not errors:
            continue
        pieces = int(SPARE * (like.difference(2 * BANDS[band]) + 1)) + 1
        where = ((values >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)
        filled, starts = np.unique(where, return_index=True)
        bits, contents = np.bincount(where, minlength=pieces), np.zeros(pieces, np.uint64)
        contents[filled] = np.bitwise_xor.reduceat(hashes, starts)
        keys = mixed(contents ^ mixed(np.arange(pieces, dtype=np.uint64) << np.uint64(8) | np.uint64(band)))
        order = np.lexsort((keys, bits))
        out.append(keys[order[pieces - errors - 1:]])
    return np.concatenate(out)


def sets(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """(id, n_shingles, set_id, sketch, long_sketch) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(value.as_py(), like.size) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(f) for f in found], pa.int64()),
                pa.array([set_hash(f) if len(f) else None for f in found], pa.binary()),
                pa.array([small_sketch(f) for f in found], pa.list_(pa.int64())),
                pa.array([long_sketch(f) for f in found], pa.list_(pa.int64())),
            ], ["id", "n_shingles", "set_id", "sketch", "long_sketch"])

    return docs.select(F.col(key).alias("id"), text).mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, n_shingles BIGINT, set_id BINARY,"
             " sketch ARRAY<BIGINT>, long_sketch ARRAY<BIGINT>")


def short_id(set_id: str = "set_id"):
    """The first eight bytes of a set's hash, which are enough to find it by; sets that
    share them are told apart when they are verified."""
    return F.conv(F.hex(F.substring(set_id, 1, 8)), 16, -10).cast("bigint")


def buckets(docs: DataFrame, like: Likeness, text: str) -> DataFrame:
    """(bucket, short_id) of the pieces that sets of different hash share.

    Rows are sent once, ordered by piece, and read as a stream, so that a bucket of any
    size takes no memory.  A task sends a set once, however many copies it reads.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            keys, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for value in batch.column(0):
                found = shingles(value.as_py(), like.size)
                name = set_hash(found)
                if not len(found) or name in sent:
                    continue
                if len(sent) >= 1_000_000:
                    sent.clear()
                sent.add(name)
                keys.append(piece_keys(found, like))
                ids.append(np.full(len(keys[-1]), int.from_bytes(name[:8], "big", signed=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids))],
                ["bucket", "short_id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of buckets with two sets or more.  The rows come in order; the first row
        of the bucket that is open is held back until a second set shows up in it."""
        first: tuple[int, int] | None = None  # of the open bucket, if it is not yet out
        last: tuple[int, int] | None = None
        for batch in batches:
            bucket, name = (c.to_numpy() for c in batch.columns)
            if not len(bucket):
                continue
            before_b = np.concatenate([[last[0] if last else ~bucket[0]], bucket[:-1]])
            before_n = np.concatenate([[last[1] if last else 0], name[:-1]])
            same = bucket == before_b
            fresh = ~(same & (name == before_n))
            bucket_f, name_f, same_f = bucket[fresh], name[fresh], same[fresh]
            last = int(bucket[-1]), int(name[-1])
            if not len(bucket_f):
                continue
            # A fresh row goes out if its bucket is open or goes on after it.
            goes_on = np.append(same_f[1:], False)
            out_b, out_n = bucket_f[same_f | goes_on], name_f[same_f | goes_on]
            if same_f[0] and first is not None:
                out_b, out_n = np.append(out_b, first[0]), np.append(out_n, first[1])
            if not same_f[-1]:
                first = int(bucket_f[-1]), int(name_f[-1])
            else:
                first = None
            yield pa.RecordBatch.from_arrays([pa.array(out_b), pa.array(out_n)],
                                             ["bucket", "short_id"])

    schema = "bucket BIGINT, short_id BIGINT"
    parts = docs.select(text).mapInArrow(emit, schema)
    return parts.repartition("bucket").sortWithinPartitions("bucket", "short_id").mapInArrow(
        shared, schema)


def with_parts(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(b, parts): the parts that each b's pairs are dealt out in, so that a task holds one
    set and reads some others as a stream; and the pairs (a, b, part)."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).alias("parts"))
    return parts, pairs.join(parts, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))


def heads_of(texts: DataFrame) -> DataFrame:
    """(b, part, a, text) of the texts (b, parts, text) that others are compared with."""
    return texts.select("b", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"),
                        F.lit(None).cast("bigint").alias("a"), "text")


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the texts (id, text)."""
    parts, dealt = with_parts(pairs)
    heads = heads_of(parts.join(texts, F.col("b") == F.col("id")))
    members = dealt.join(texts, F.col("a") == F.col("id")).select("b", "part", "a", "text")
    return compared(heads, members, like)


def compared(heads: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of a member and its head whose sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for b, part, a, text in zip(*(c.to_pylist() for c in batch.columns)):
                values = shingles(text, like.size)
                if (b, part) != head:
                    head, own = (b, part), []
                if a is None:
                    own.append(values)
                elif any(like.linked(values, one) for one in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return heads.unionByName(members).repartition("b", "part").sortWithinPartitions(
        "b", "part", F.col("a").asc_nulls_first()).mapInArrow(run, "a BIGINT, b BIGINT").distinct()


def jaccard_components(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """(id, n_shingles, class_id, component_id, n_links) of every row.

    class_id is the smallest id with the same set, n_links the number of links of that
    class with other classes that had to be verified to know its component."""
    known = stored(sets(docs, like, key, text), "shingle-sets")
    classes = known.filter("set_id IS NOT NULL AND id IS NOT NULL").groupBy(
        "set_id", "n_shingles").agg(F.min("id").alias("class_id"), F.first("sketch").alias("sketch"),
                                    F.first("long_sketch").alias("long_sketch"))
    classes = stored(classes, "set-classes")
    names = classes.select(short_id().alias("short_id"), F.col("class_id").alias("node"))
    shared = buckets(docs.filter(F.col(key).isNotNull()), like, text)
    meet = stored(shared.join(names, "short_id").select("bucket", "node"), "buckets")

    def about(side: str) -> DataFrame:
        """Size and sketch of the nodes in column ``side``."""
        return classes.select(F.col("class_id").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                              F.col("sketch").alias(f"sketch_{side}"))

    firsts = meet.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    seats = stored(meet.join(firsts.filter("first < last"), "bucket"), "bucket-seats")
    met = seats.filter("node <> first").select(
        F.col("node").alias("a"), F.col("first").alias("b")).distinct()

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs that the long sketches leave; only these pairs' sketches are moved."""
        for side in ("a", "b"):
            pairs = pairs.join(classes.select(
                F.col("class_id").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                F.col("long_sketch").alias(f"long_{side}")), side)
        return pairs.filter(may_link_closely(like)).select("a", "b")

    near = met.join(about("a"), "a").join(about("b"), "b").filter(may_link(like)).select("a", "b")
    near = stored(close(near), "near-pairs")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        return stored(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
            ids, "id", "left_semi"), name)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component yet."""
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}")),
                               side, "left")
        other = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
        return pairs.filter(other).select("a", "b")

    # Each node with the smallest first it has met, then with the others that are needed.
    # Texts are fetched together with what they are to be compared with.
    tried = stored(near.groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    parts, dealt = with_parts(tried)
    roles = ends(near).join(dealt.withColumnRenamed("a", "id"), "id", "left").join(
        parts.withColumnRenamed("b", "id"), "id", "left")
    fetched = stored(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        roles, "id"), "pair-texts")
    texts = fetched.select("id", "text")
    heads = heads_of(fetched.filter("parts IS NOT NULL").select(F.col("id").alias("b"), "parts", "text"))
    members = fetched.filter("b IS NOT NULL").select("b", "part", F.col("id").alias("a"), "text")
    links = stored(compared(heads, members, like), "first-links")
    again = stored(apart(near.join(tried, ["a", "b"], "left_anti"), components(links)), "more-pairs")
    tried = tried.unionByName(again)
    links = stored(links.unionByName(verified(again, texts, like)), "more-links")
    labels = components(links)

    # Buckets whose nodes are not all in one component by now.
    marked = seats.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed_up = marked.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("seats")
    ).filter("low < high AND seats > 2").select("bucket")
    left = marked.join(mixed_up, "bucket", "left_semi")

    def half(side: str) -> DataFrame:
        return left.withColumnsRenamed({"node": side, "label": f"label_{side}"}).join(about(side), side)

    rest = half("a").join(half("b"), "bucket").filter(
        f"a > b AND label_a <> label_b AND {may_link(like)}").select("a", "b").distinct()
    rest = stored(close(rest.join(tried, ["a", "b"], "left_anti")), "other-pairs")
    if not rest.isEmpty():
        missing = stored(ends(rest).join(texts, "id", "left_anti"), "other-ids")
        if not missing.isEmpty():
            texts = texts.unionByName(texts_of(missing, "other-texts"))
        links = stored(links.unionByName(verified(rest, texts, like)), "all-links")
    # Rows that share an id are one document: the classes of their sets belong together.
    named = known.join(classes.select("set_id", "class_id"), "set_id").select("id", "class_id")
    twice = named.groupBy("id").agg(
        F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low < high")
    same = named.join(twice.select("id"), "id", "left_semi").filter("id <> class_id").select(
        F.col("class_id").alias("a"), F.col("id").alias("b"))
    final = components(links.unionByName(same))

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
        F.count(F.lit(1)).alias("n_links"))
    nodes = final.join(degree, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("class_id"), "label", "n_links")
    return known.join(classes.select("set_id", "class_id"), "set_id", "left").select(
        "id", "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id")
    ).join(nodes, "class_id", "left").select(
        "id", "n_shingles", "class_id", F.coalesce("label", "class_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(table(spark, sf_dir, "documents"), Likeness(3, 9, 10))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
