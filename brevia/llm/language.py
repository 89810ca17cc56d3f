"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs.  An n-gram is the product of its letters'
vectors, each rotated by the letter's distance from the end; a text is the sum of its
n-grams, a language the sum of its texts.  A text gets the language whose vector makes
the smallest angle with its own, after the vector that all languages have in common is
taken away from both.

* Null texts and texts without letters: ``und``, score 0.
* Equal scores: the language that comes first in the alphabet.
* Repeated rows: each row counts in training and is answered on its own.
* An empty table, or one without a known language: every text is ``und``.
* Columns beside text, label and key are carried or ignored, never used to predict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32, table

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
# One bit for each code point: is it a letter?
IS_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
SPACE = 0x20


def codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one blank for all that stands between
    and around them; empty for a text without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    points = np.where(IS_LETTER[points], points, SPACE)
    if not len(points) or points.max() == SPACE:
        return np.empty(0, np.uint64)
    points = np.concatenate([[SPACE], points, [SPACE]]).astype(np.uint64)
    again = (points[1:] == SPACE) & (points[:-1] == SPACE)
    return points[np.concatenate([[True], ~again])]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed 21 bits a letter, and their counts."""
    letters = codes(text or "")
    n = len(letters) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        packed = packed << np.uint64(21) | letters[k:k + n]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of n-grams, made when first needed and kept up to ``most`` of them."""

    def __init__(self, dimensions: int, most: int = 20_000):
        self.dimensions, self.most = dimensions, most
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.made = np.empty((0, dimensions), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            draw = np.random.Generator(np.random.PCG64(xxhash.xxh64_intdigest(str(code))))
            self.letters[code] = draw.choice(np.array([-1, 1], np.float32), self.dimensions)
        return self.letters[code]

    def gram(self, packed: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.float32)
        for k in range(GRAM):
            out = out * np.roll(self.letter(packed >> 21 * k & 0x1FFFFF), k)
        return out

    def bundle(self, packed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of n-gram vectors, each as often as it is counted."""
        total = np.zeros(self.dimensions)
        for at in range(0, len(packed), self.most):
            part = packed[at:at + self.most].tolist()
            fresh = [g for g in part if g not in self.rows]
            if fresh:
                if len(self.rows) + len(fresh) > self.most:
                    self.rows.clear()
                    self.made, fresh = self.made[:0], part
                self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
                if len(self.rows) > len(self.made):
                    room = min(self.most, max(2 * len(self.made), len(self.rows)))
                    self.made = np.concatenate(
                        [self.made, np.empty((room - len(self.made), self.dimensions), np.float32)])
                for g in fresh:
                    self.made[self.rows[g]] = self.gram(g)
            where = np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))
            total += counts[at:at + self.most].astype(np.float32) @ self.made[where]
        return total


def profiles(docs: DataFrame, text: str = "text", label: str = "lang",
             dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The vector of every label, over all rows with one.

    A task adds up the n-gram counts of each label and sends its vectors' sums, so the
    shuffle does not grow with the texts.  The driver gets ``dimensions`` numbers for
    each label.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(dimensions)
        counts: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}

        def flush(lang: str) -> None:
            seen = counts.pop(lang)
            sums[lang] = sums.get(lang, 0) + vectors.bundle(
                np.array(list(seen), np.uint64), np.array(list(seen.values()), np.int64))

        for batch in batches:
            for value, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                seen = counts.setdefault(lang, {})
                packed, n = grams(value.as_py())
                for g, m in zip(packed.tolist(), n.tolist()):
                    seen[g] = seen.get(g, 0) + m
                if len(seen) > 100_000:
                    flush(lang)
        for lang in list(counts):
            flush(lang)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()),
             pa.array([sums[n].round() for n in names], pa.list_(pa.float64()))], ["lang", "sums"])

    known = docs.filter(F.col(label).isNotNull()).select(text, F.col(label).cast("string"))
    parts = known.mapInArrow(run, "lang STRING, sums ARRAY<DOUBLE>")
    rows = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(
        F.sum("col").alias("total")).collect()
    out: dict[str, np.ndarray] = {}
    for row in rows:
        out.setdefault(row["lang"], np.zeros(dimensions))[row["pos"]] = row["total"]
    return {name: out[name] for name in sorted(out)}


class Classifier:
    """Compares texts with the languages' profiles."""

    def __init__(self, learnt: dict[str, np.ndarray], dimensions: int = DIMENSIONS):
        self.names = list(learnt)
        self.vectors = Vectors(dimensions)
        units = np.array([self.unit(v) for v in learnt.values()]).reshape(-1, dimensions)
        self.common = units.mean(axis=0) if len(units) > 1 else np.zeros(dimensions)
        self.units = np.array([self.unit(v - self.common) for v in units]).reshape(-1, dimensions)

    @staticmethod
    def unit(vector: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(vector)
        return vector / length if length else vector

    def __call__(self, text: str | None) -> tuple[str, float]:
        packed, counts = grams(text)
        if not len(packed) or not self.names:
            return UNKNOWN, 0.0
        near = self.units @ self.unit(self.unit(self.vectors.bundle(packed, counts)) - self.common)
        best = int(near.argmax())
        return self.names[best], float(np.clip(near[best], 0, 1))


def predict(docs: DataFrame, learnt: dict[str, np.ndarray], text: str = "text",
            pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language and the cosine, 0 to 1, added."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(learnt)
        for batch in batches:
            found = [classify(value.as_py()) for value in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, pred, score],
            )

    schema = T.StructType([*docs.schema, T.StructField(pred, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row is kept from training: its key's CRC-32 is divisible by ``folds``."""
    return crc32(key.cast("string")) % folds == 0


def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnt = profiles(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), learnt).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
