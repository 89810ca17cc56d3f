"""Substring deduplication by automata of repeated phrases.

A word is removed if a run of ``window`` words that covers it also starts in a document
with a smaller id.

1. Documents with one sequence of words are a class; all but those with its smallest id
   go as a whole, if they are as long as a window.
2. Every window has a sampled phrase of a few words, that with the least hash, so equal
   windows have equal phrases.  Phrases of documents of different classes that are equal
   are confirmed, by their text, to recur.
3. Documents are dealt into blocks of about equal size.  Each block is a shard: the
   recurring phrases of its documents are compiled into one Aho-Corasick automaton, and
   the documents of the block are streamed through it.  Shards follow the data in
   number and keep their size.
4. Windows whose phrase the automaton has found are looked up across documents, and
   those that start in a smaller document are removed.

* Null text: no words.  Shorter than a window: nothing is removed.
* Repeated rows, or rows with one id: the same document; they do not take from each other.
* Null id: the row stays whole and takes from no other.
* An empty table: no rows.
* Columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, signed, split_words, stored, table, window_hashes, word_hashes

WINDOW = 50
PHRASE = 6
BLOCK_BYTES = 8 << 20
# A task compares about this many windows with each other before it sends them.
AT_HAND = 1 << 19
SEVERAL = "several texts"
EMPTY = hashlib.sha256(b"").hexdigest()


def sequence_hash(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def tag(sequence: bytes) -> int:
    """31 bits that tell apart the texts of rows with one id."""
    return int.from_bytes(sequence[:4], "big") >> 1


def sampled(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` phrases the least of their hashes.  Minima over runs of
    1, 2, 4 ... phrases are put together, so long runs cost few steps."""
    reach, least = 1, hashes
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def changes(chosen: np.ndarray) -> np.ndarray:
    """The windows whose sampled phrase is not that of the window before."""
    return np.concatenate([[0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1])


def sampled_at(hashes: np.ndarray, chosen: np.ndarray, span: int) -> np.ndarray:
    """A place of each distinct sampled phrase.  Only windows with another phrase than
    their predecessor are looked into."""
    at = changes(chosen)
    _, first = np.unique(chosen[at], return_index=True)
    at = at[first]
    return at + np.lib.stride_tricks.sliding_window_view(hashes, span)[at].argmin(axis=1)


def phrases_of(words: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the phrase at each word, and of the phrase sampled for each window; a
    text must be as long as a window."""
    hashes = window_hashes(words, size, seed=7)
    return hashes, sampled(hashes, window - size + 1)


class Rolling:
    """Hashes of long runs of words from sums of words times powers of an odd number."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray, size: int) -> np.ndarray:
        if len(self.up) < len(words):
            self.up, self.down = (np.cumprod(np.concatenate([
                np.ones(1, np.uint64), np.full(2 * len(words), b, np.uint64)]))
                for b in (self.base, self.inverse))
        sums = np.concatenate([np.zeros(1, np.uint64),
                               np.cumsum(mixed(words) * self.down[:len(words)])])
        return mixed((sums[size:] - sums[:-size]) * self.up[:len(words) - size + 1])


def sequences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_words, n_bytes, sequence) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, words), pa.int64()),
                pa.array((sum(map(len, w)) + len(w) for w in words), pa.int64()),
                pa.array(map(sequence_hash, words), pa.binary()),
            ], ["id", "n_words", "n_bytes", "sequence"])

    return docs.select(F.col(key).alias("id"), text).mapInArrow(
        run, f"id {docs.schema[key].dataType.simpleString()}, n_words BIGINT, n_bytes BIGINT,"
             " sequence BINARY")


def block_of(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def recurring_phrases(docs: DataFrame, blocks: int, window: int, size: int) -> DataFrame:
    """(block, phrase): each phrase that documents of different text share, with every
    block that has it.

    A task sends a phrase once with the numbers of its blocks, however many documents have
    it, and the set of all its blocks has one small number for each block at most.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int]] = []
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(text.as_py())
                if len(words) < window:
                    continue
                name = int.from_bytes(sequence_hash(words)[:8], "big", signed=True)
                every, chosen = phrases_of(word_hashes(words), window, size)
                starts = sampled_at(every, chosen, window - size + 1).tolist()
                out += [(block, b" ".join(words[s:s + size]), name) for s in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()),
                 pa.array([o[1] for o in out], pa.binary()).cast(pa.string()),
                 pa.array([o[2] for o in out], pa.int64())], ["block", "phrase", "name"])

    seen = docs.select("block", "text").mapInArrow(run, "block INT, phrase STRING, name BIGINT")
    held = seen.groupBy("phrase").agg(F.min("name").alias("low"), F.max("name").alias("high"),
                                      F.collect_set("block").alias("blocks"))
    return held.filter("low < high").select(F.explode("blocks").alias("block"), "phrase")


class Shard:
    """The automaton of a block's phrases."""

    def __init__(self, phrases: list[str], size: int):
        self.size = size
        self.automaton = ahocorasick.Automaton()
        for phrase in phrases:
            self.automaton.add_word(f" {phrase} ", True)
        self.automaton.make_automaton()

    def starts(self, words: list[bytes]) -> np.ndarray:
        """The words at which one of the phrases starts, in order."""
        if not len(self.automaton):
            return np.empty(0, np.int64)
        line = f" {b' '.join(words).decode()} "
        ends = np.fromiter((end for end, _ in self.automaton.iter(line)), np.int64)
        if not len(ends):
            return ends
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 0x20)
        return np.searchsorted(blanks, ends) - self.size


LOCATED = ("id BIGINT, n_words BIGINT, kept_sha256 STRING, whole BOOLEAN, tag BIGINT, text STRING,"
           " runs ARRAY<INT>")


def located(docs: DataFrame, phrases: DataFrame, copies: DataFrame, shared: DataFrame, blocks: int,
            window: int, size: int) -> DataFrame:
    """Each row with the windows that may recur, as runs of starts; its text too, if there
    are any.  ``whole`` tells that all of its words go, as it is a copy.  ``tag`` is 0 but
    for the ids in ``shared``, which have several texts."""
    rows = docs.select("block", F.lit(2).alias("kind"), "id", "text").unionByName(
        phrases.select("block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"),
                       F.col("phrase").alias("text"))).unionByName(
        copies.select(block_of("id", blocks).alias("block"), F.lit(1).alias("kind"), "id",
                      F.lower(F.hex("sequence")).alias("text"))).unionByName(
        shared.select(block_of("id", blocks).alias("block"), F.lit(1).alias("kind"), "id",
                      F.lit(SEVERAL).alias("text")))
    ordered = rows.repartition(blocks, "block").sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, phrases_, copies_, shard = None, [], set(), None
        for batch in batches:
            out: list[tuple] = []
            for at, kind, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != block:
                    block, phrases_, copies_, shard = at, [], set(), None
                if kind == 0:
                    phrases_.append(text)
                elif kind == 1:
                    copies_.add((key, text))
                else:
                    shard = shard or Shard(phrases_, size)
                    out.append(place(key, text, shard, copies_))
            columns = list(zip(*out)) if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(),
                    pa.list_(pa.int32())))],
                ["id", "n_words", "kept_sha256", "whole", "tag", "text", "runs"])

    def place(key, text, shard, copies_) -> tuple:
        words = split_words(text)
        name = sequence_hash(words)
        mark = tag(name) if (key, SEVERAL) in copies_ else 0
        if (key, name.hex()) in copies_:
            return key, len(words), EMPTY, True, mark, None, []
        runs: list[int] = []
        if key is not None and len(words) >= window and len(found := shard.starts(words)):
            every, chosen = phrases_of(word_hashes(words), window, size)
            at = changes(chosen)
            may = np.repeat(np.isin(chosen[at], every[found]), np.diff(at, append=len(chosen)))
            runs = np.flatnonzero(np.diff(may.astype(np.int8), prepend=0, append=0)).tolist()
        digest = hashlib.sha256(b" ".join(words)).hexdigest()
        return key, len(words), digest, False, mark, text if runs else None, runs

    return ordered.mapInArrow(run, LOCATED)


def settled(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows are equal to one with a smaller id; windows come in order of their ids.
    Of windows whose first hashes only are equal, fewer may be told."""
    order = np.argsort(h1, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
    first = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.empty(len(order), bool)
    out[order] = ids[order] > first
    return out


def windows(rows: DataFrame, window: int) -> DataFrame:
    """(h1, h2, id, spot, length) of the windows in the rows' runs; a spot is tag and start.

    A task compares the windows it has at hand.  Those that have a smaller document among
    them are known to go: each run of them is one row with its length, and a hash of the id
    in place of the window's, so that a window which very many documents have is sent about
    once a task.  The others have length 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            held, size = [], 0
            for row in np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable").tolist():
                key, mark, text, runs = (column[row].as_py() for column in batch.columns)
                values = word_hashes(split_words(text))
                for begin, end in zip(runs[::2], runs[1::2]):
                    part = values[begin:end + window - 1]
                    held.append((signed(one(part, window)),
                                 signed(two(part, window) >> np.uint64(49)).astype(np.int16),
                                 np.full(end - begin, key, np.int64),
                                 np.arange(begin, end, dtype=np.int64) | mark << 32))
                    size += end - begin
                if size >= AT_HAND:
                    yield compared(held)
                    held, size = [], 0
            if held:
                yield compared(held)

    def compared(held: list[tuple]) -> pa.RecordBatch:
        h1, h2, ids, spots = map(np.concatenate, zip(*held))
        gone = settled(h1, h2, ids)
        same = gone[1:] & gone[:-1] & (ids[1:] == ids[:-1]) & (spots[1:] == spots[:-1] + 1)
        begins = np.flatnonzero(gone & ~np.concatenate([[False], same]))
        ends = np.flatnonzero(gone & ~np.concatenate([same, [False]]))
        rest = ~gone
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([h1[rest], signed(mixed(ids[begins].view(np.uint64)))])),
            pa.array(np.concatenate([h2[rest], np.zeros(len(begins), np.int16)])),
            pa.array(np.concatenate([ids[rest], ids[begins]])),
            pa.array(np.concatenate([spots[rest], spots[begins]])),
            pa.array(np.concatenate([np.zeros(rest.sum(), np.int32),
                                     (ends - begins + 1).astype(np.int32)])),
        ], ["h1", "h2", "id", "spot", "length"])

    return rows.select("id", "tag", "text", "runs").mapInArrow(
        run, "h1 BIGINT, h2 SMALLINT, id BIGINT, spot BIGINT, length INT")


def later(seen: DataFrame) -> DataFrame:
    """(id, spot, length): the runs known to go, and of equal windows those that do not have
    the smallest id.  Windows are sent once; a task reads them in order and remembers the
    last one's smallest id only."""
    ordered = seen.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            h1, h2, ids, spots, length = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gone = length > 0
            open_ = np.flatnonzero(~gone)
            if len(open_):
                a, b, mine = h1[open_], h2[open_], ids[open_]
                new = np.ones(len(open_), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                first = mine[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
                if last and last[:2] == (a[0], b[0]):
                    until = np.flatnonzero(new[1:])
                    first[:until[0] + 1 if len(until) else len(first)] = last[2]
                gone[open_] = mine > first
                last = a[-1], b[-1], first[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[gone]), pa.array(spots[gone]),
                 pa.array(np.maximum(length[gone], 1).astype(np.int32))], ["id", "spot", "length"])

    return ordered.mapInArrow(run, "id BIGINT, spot BIGINT, length INT")


def trimmed(rows: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept): the rows' words without those that the windows of
    the runs in ``gone`` cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, starts in zip(*(c.to_pylist() for c in batch.columns)):
                words = split_words(text)
                edges = np.zeros(len(words) + 1, np.int64)
                for piece in starts or ():
                    edges[piece["start"]] += 1
                    edges[piece["start"] + piece["length"] - 1 + window] -= 1
                gone = edges.cumsum()[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone) if not g).decode()
                out.append((key, len(words), int(gone.sum()), kept))
            columns = list(zip(*out)) if out else [[] for _ in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["id", "n_words", "n_removed", "kept"])

    return rows.select("id", "text", "gone").mapInArrow(
        run, "id BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING")


def remove_passages(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    window: int = WINDOW, size: int = PHRASE,
                    block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables that together have every row: (id, n_words, n_removed, kept) of those
    that lose some words or might have, and (id, n_words, n_removed, kept_sha256) of those
    that stay whole or go whole, whose text need not be written."""
    facts = stored(sequences(docs, key, text), "sequences")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    classes = facts.filter(f"id IS NOT NULL AND n_words >= {window}").select("id", "sequence")
    least = classes.groupBy("sequence").agg(F.min("id").alias("least"))
    copies = classes.join(least, "sequence").filter("id > least").select("id", "sequence").distinct()

    shared = facts.filter("id IS NOT NULL").groupBy("id").agg(
        F.min("sequence").alias("low"), F.max("sequence").alias("high")).filter("low < high").select("id")

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"),
                       block_of(key, blocks).alias("block"))
    phrases = recurring_phrases(rows, blocks, window, size)
    found = stored(located(rows, phrases, copies, shared, blocks, window, size),
                   "located")

    maybe = found.filter(F.size("runs") > 0)
    start = F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int").alias("start")
    gone = later(windows(maybe, window)).groupBy("id", F.shiftright("spot", 32).alias("tag")).agg(
        F.collect_list(F.struct(start, "length")).alias("gone"))
    cut = trimmed(maybe.join(gone, ["id", "tag"], "left"), window)
    rest = found.filter(F.size("runs") == 0).select(
        "id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(0).cast("bigint")
        .alias("n_removed"), "kept_sha256")
    return cut, rest


def q_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, rest = remove_passages(table(spark, sf_dir, "documents"))
    return cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").unionByName(
        rest).withColumnRenamed("id", "doc_id")
