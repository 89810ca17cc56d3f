"""Quality by weak supervision.

Each rule looks at a text's measures and votes good (1), bad (-1) or abstains (0).  No
rule is trusted outright: expectation-maximisation over all documents estimates how
often each rule votes what on good and on bad texts, and a text is kept by the
posterior probability that it is good.

* Null and empty texts: all measures 0, no votes but "bad" for their length.
* Repeated rows and ties: each row counts and is judged on its own.
* An empty table: no rows; the rules keep their starting accuracies.
* Columns beside the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_words, stored, table

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LETTERS = re.compile(r"[^\W\d_]+")
BARE = frozenset(sign.encode() for sign in "|-–—•·/\\+=~^_@" + SYMBOLS)
NOISE_RUN = re.compile(r"[#*$%&|<>!]{2,}")
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_letters", "n_upper", "n_exclaims", "n_closed_lines", "n_noise_runs",
    "n_bare_words",
)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside runs of ``size`` words that occur twice or more."""
    n = len(words) - size + 1
    if n <= 1:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # Runs are numbered one word after the other, so that numbers stay below n squared.
    runs = ids[:n]
    for k in range(1, size):
        runs = np.unique(runs, return_inverse=True)[1] * np.int64(len(seen)) + ids[k:k + n]
    _, which, counts = np.unique(runs, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words), bool)
    again = np.flatnonzero(counts[which] > 1)
    for k in range(size):
        marks[again + k] = True
    return int(marks.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    text = text or ""
    words = split_words(text)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    letters = sum(map(len, LETTERS.findall(text)))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        letters,
        sum(map(str.isupper, text)) if letters else 0,
        text.count("!"),
        sum(line.rstrip(SPACES).endswith((".", "?", "!", ":", '"', "”")) for line in lines),
        len(NOISE_RUN.findall(text)),
        sum(map(BARE.__contains__, words)),
    )


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures) of every document."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(value.as_py()) for value in batch.column(1)]
            columns = zip(*rows) if rows else [[] for _ in MEASURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)],
                [key, *MEASURES],
            )

    schema = f"`{key}` {kind.simpleString()}, " + ", ".join(f"{m} BIGINT" for m in MEASURES)
    return docs.select(key, text).mapInArrow(run, schema)


class Rule(NamedTuple):
    """Votes bad where ``bad`` holds, good where ``good`` holds, else not at all."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 20", "n_words >= 100"),
    Rule("word_length", "word_chars < 2.5 * n_words OR word_chars > 11 * n_words",
         "word_chars BETWEEN 3.5 * n_words AND 8 * n_words"),
    Rule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("lines", "n_dup_lines >= 3 AND n_dup_lines > 0.3 * n_lines", "n_lines >= 3 AND n_dup_lines <= 0.1 * n_lines"),
    Rule("phrases", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    Rule("capitals", "n_upper > 0.4 * n_letters", "n_upper <= 0.15 * n_letters"),
    Rule("exclaims", "n_exclaims > 0.2 * n_words", "n_exclaims <= 0.03 * n_words"),
    Rule("closed_lines", "n_lines >= 3 AND n_closed_lines < 0.2 * n_lines",
         "n_closed_lines >= 0.7 * n_lines"),
    Rule("bare_words", "n_bare_words > 0.15 * n_words", "n_bare_words <= 0.05 * n_words"),
    Rule("noise_runs", "n_noise_runs > 0.1 * n_words", "n_noise_runs <= 0.02 * n_words"),
)


def votes(rules=RULES) -> Column:
    """The votes of all rules as one text of the signs -, 0 and +."""
    return F.concat(*(
        F.when(F.expr(rule.bad) | (F.col("n_words") == 0) & F.lit(rule.name == "length"), "-")
        .when(F.expr(rule.good) & (F.col("n_words") > 0), "+").otherwise("0")
        for rule in rules
    ))


class LabelModel(NamedTuple):
    """Share of good texts, and for each rule that does not abstain the chance of each
    vote on bad and good texts: an array of rules x (bad, good) x (-, +).  To abstain
    tells nothing."""

    prior: float
    chances: np.ndarray

    def weight(self, rule: int, vote: str) -> float:
        """What a vote adds to the logarithm of the odds for good."""
        if vote == "0":
            return 0.0
        bad, good = self.chances[rule, :, "-+".index(vote)]
        return float(np.log(good) - np.log(bad))

    def posterior(self, pattern: str) -> float:
        odds = np.log(self.prior) - np.log1p(-self.prior)
        for rule, vote in enumerate(pattern):
            odds += self.weight(rule, vote)
        return float(1 / (1 + np.exp(-odds)))


def fit(counts: dict[str, int], n_rules: int, steps: int = 100, even: float = 2.0) -> LabelModel:
    """Expectation-maximisation over how many documents have each pattern of votes.

    The start takes a bad vote to be rare on good texts and a good vote to be common on
    both, as rules name what is wrong more sharply than what is right.  ``even``
    documents of each kind and vote are added, so that no chance becomes 0.
    """
    start = np.array([[0.4, 0.6], [0.03, 0.97]])
    model = LabelModel(0.8, np.repeat(start[None], n_rules, axis=0))
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    hot = np.array([[[v == s for s in "-+"] for v in p] for p in patterns], float)
    for _ in range(steps if patterns else 0):
        good = np.array([model.posterior(p) for p in patterns])
        weights = np.stack([n * (1 - good), n * good])
        chances = np.einsum("cp,prv->rcv", weights, hot) + even
        chances /= chances.sum(axis=2, keepdims=True)
        prior = (weights[1].sum() + even) / (n.sum() + 2 * even)
        moved = abs(prior - model.prior) + np.abs(chances - model.chances).max()
        model = LabelModel(float(prior), chances)
        if moved < 1e-7:
            break
    return model


def judged(features: DataFrame, rules=RULES, least: float = 0.5) -> DataFrame:
    """Adds votes, quality (the posterior) and good to the measures.

    What reaches the driver is a count for each pattern of votes, of which there are
    three to the number of rules at most, however many documents there are.
    """
    voted = features.withColumn("votes", votes(rules))
    counts = {row["votes"]: row["n"] for row in
              voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit(counts, len(rules))
    odds = F.lit(float(np.log(model.prior) - np.log1p(-model.prior)))
    for rule in range(len(rules)):
        vote = F.substring("votes", rule + 1, 1)
        odds = odds + F.when(vote == "-", model.weight(rule, "-")).when(
            vote == "+", model.weight(rule, "+")).otherwise(0.0)
    return voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn(
        "good", F.col("quality") >= least)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stored(measured(table(spark, sf_dir, "documents")), "quality-measures")
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return judged(features).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "votes", "quality",
    )
