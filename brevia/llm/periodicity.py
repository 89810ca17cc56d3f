"""Periodic runs of words, found while words are appended, by dyadic square catching.

A run is a longest stretch of words with smallest period q and at least four periods (and
LEAST words).  For each power of two b the words are cut into blocks of b words.  A block
that is complete becomes a catcher for periods from b to 2 * b - 1: each appended word
completes a suffix of b words, and at every level exactly one catcher is due for it, the
one that began q words before.  A catcher whose block equals the suffix has caught a
square's halves; if the block also stands q words before itself, the squares are merged
into the stretch of all words that equal those q words later, which grows as long as
appended words go on with it.  A run of four periods holds such a block at the level
of its period, so none is missed.  So a word costs one comparison a level.

Blocks and suffixes are compared by 64-bit hashes, which are doubled from level to
level; stretches compare the words themselves, so no run is reported by chance.  What lies
in a run of a smaller period is its multiple and is left out.

* Null or wordless text: no runs, an empty collapsed text.
* Ties: equal stretches count once, with their smallest period; of runs of one length
  the query reports the first.
* Null id: a document like any other.  Repeated rows: each row on its own.
* An empty table: no rows.  Very long texts: n log n steps and numbers.
* Columns beside the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, split_words, table

LEAST = 6
PERIODS = 4
RUN = "STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>"
ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Words = list[bytes]


class Runs:
    """The runs of a sequence of word numbers that is appended to."""

    def __init__(self, least: int = LEAST, periods: int = PERIODS):
        assert periods >= 4, "a block of each run is caught from four periods on"
        self.least, self.periods = least, periods
        self.words = np.empty(0, np.int64)
        self.hashes: list[np.ndarray] = []  # by level: of the windows of 2 ** level words
        # Stretches [first, end, q]: words from first to end equal those q words later.
        self.last: dict[int, list[int]] = {}  # the last one of a period
        self.kept: list[list[int]] = []  # the long ones

    def append(self, words: np.ndarray) -> None:
        before = len(self.words)
        self.words = np.concatenate([self.words, words]) if before else words
        n = len(self.words)
        for stretch in self.last.values():
            if stretch[1] + stretch[2] == before:
                self.grow(stretch)
        level = 0
        while self.periods << level <= n:
            seen = self.double(level)
            self.catch(level, seen)
            level += 1

    def double(self, level: int) -> int:
        """Hash the windows that end in appended words; how many there were before."""
        if level == len(self.hashes):
            self.hashes.append(np.empty(0, np.uint64))
        known = self.hashes[level]
        with np.errstate(over="ignore"):
            if level == 0:
                fresh = (self.words[len(known):].astype(np.uint64) + np.uint64(1)) * ODD
            else:
                half, b = self.hashes[level - 1], 1 << level - 1
                fresh = half[len(known):len(half) - b] * ODD + half[len(known) + b:]
            fresh ^= fresh >> np.uint64(29)
        self.hashes[level] = np.concatenate([known, fresh]) if len(known) else fresh
        return len(known)

    def catch(self, level: int, seen: int) -> None:
        """Compare the suffixes from number ``seen`` on with the catchers due for them."""
        b, hashes = 1 << level, self.hashes[level]
        at = max(seen, b)
        # The catcher of the suffix at x is the block before the one x lies in.
        block = at // b - 1
        due = np.repeat(hashes[block * b:max(block * b, len(hashes) - b):b], b) if b > 1 else hashes
        due = due[at - b - block * b:][:len(hashes) - at] if b > 1 else hashes[at - 1:len(hashes) - 1]
        x = np.flatnonzero(hashes[at:] == due) + at
        if not len(x):
            return
        period = b + x % b
        earlier = x - 2 * period
        x, period, earlier = (v[earlier >= 0] for v in (x, period, earlier))
        caught = hashes[earlier] == hashes[x]
        x, period = x[caught], period[caught]
        inside = self.inside(x - period, x + b, b)
        x, period = x[~inside], period[~inside]
        for q in np.unique(period).tolist():
            blocks, at = x[period == q] - q, 0
            while at < len(blocks):
                first, stretch = int(blocks[at]), self.last.get(q)
                if stretch is None or first + b > stretch[1]:
                    stretch = [first, first, q]
                    self.grow(stretch)
                    if stretch[1] >= first + b:  # else equal hashes of unequal words
                        self.shrink_start(stretch)
                        self.last[q] = stretch
                at = max(at + 1, int(np.searchsorted(blocks, stretch[1] - b, "right")))

    def inside(self, first: np.ndarray, end: np.ndarray, period: int) -> np.ndarray:
        """Whether a known run of a period up to ``period`` covers first to end."""
        runs = sorted((s, e + q) for s, e, q in self.kept if q <= period)
        if not runs or not len(first):
            return np.zeros(len(first), bool)
        starts, ends = np.array(runs).T
        ends = np.maximum.accumulate(ends)
        place = np.searchsorted(starts, first, "right") - 1
        return (place >= 0) & (ends[place] >= end)

    def grow(self, stretch: list[int]) -> None:
        """Move the stretch's end over all words that go on with its period."""
        first, end, q = stretch
        n, step = len(self.words) - q, 16
        while end < n:
            stop = min(n, end + step)
            equal = self.words[end:stop] == self.words[end + q:stop + q]
            if not equal.all():
                end += int(equal.argmin())
                break
            end, step = stop, step * 4
        was_short = stretch[1] - first + q < self.periods * q
        stretch[1] = end
        if was_short and end - first + q >= self.periods * q:
            self.kept.append(stretch)

    def shrink_start(self, stretch: list[int]) -> None:
        """Move the stretch's start back over all words that have its period."""
        first, end, q = stretch
        was_short, step = end - first + q < self.periods * q, 16
        while first > 0:
            stop = max(0, first - step)
            equal = self.words[stop:first] == self.words[stop + q:first + q]
            if not equal.all():
                first -= int(equal[::-1].argmin())
                break
            first, step = stop, step * 4
        stretch[0] = first
        if was_short and end - first + q >= self.periods * q:
            self.kept.append(stretch)

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of each run, by start and then period."""
        smallest: dict[tuple[int, int], int] = {}
        for first, end, q in self.kept:
            if end - first + q >= self.least:
                place = first, end - first + q
                smallest[place] = min(q, smallest.get(place, q))
        return sorted((*place, q) for place, q in smallest.items())


def numbered(words: Words) -> np.ndarray:
    """Equal numbers for equal words."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


def word_runs(words: Words) -> list[tuple[int, int, int]]:
    if len(words) < LEAST:
        return []
    runs = Runs()
    runs.append(numbered(words))
    return runs.found()


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [word for word, stays in zip(words, keep.tolist()) if stays]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  prepare: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """(key, n_words, runs, collapsed) of each document; a narrow step.

    ``prepare`` may change a document's words by its key before they are searched.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key_, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = split_words(value.as_py())
                if prepare is not None:
                    words = prepare(key_, words)
                found = word_runs(words)
                out.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in found],
                            b" ".join(collapsed(words, found)).decode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in out], pa.int64()),
                 pa.array([r[1] for r in out], pa.list_(ARROW_RUN)),
                 pa.array([r[2] for r in out], pa.string())],
                [key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_words BIGINT, runs ARRAY<{RUN}>, collapsed STRING")


def planted(key: int | None, words: Words) -> Words:
    """The query's rule: one document in ten, chosen by its id's CRC-32, goes on
    periodically from a word on."""
    hashed = zlib.crc32(str(key).encode())
    n, g = len(words), hashed // 10
    if key is None or hashed % 10 or not n:
        return words
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    cycle = words[first:first + period]
    return words[:first] + (cycle * (1 + (n - first) // len(cycle)))[:n - first]


def q_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), prepare=planted)

    def by_length(a: Column, b: Column) -> Column:
        """The longest first; the earliest of equal ones, then the smallest period."""
        order = [b["length"] - a["length"], a["start"] - b["start"], a["period"] - b["period"]]
        out = F.lit(0)
        for part in reversed(order):
            out = F.when(part != 0, F.signum(part).cast("int")).otherwise(out)
        return out

    longest = F.get(F.array_sort("runs", by_length), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *(F.col("longest")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(F.expr("1000 * longest.length div longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
