"""Mixing to target weights with soft membership in domains.

A classifier fitted on the labelled table gives every document its chances to belong to
each domain.  A document adds tokens to a domain by its chance for it.  Projected-gradient
least squares finds a rate for every document, from zero to MOST_COPIES, so that the
domains' expected tokens come as close as can be to what their target weights ask for.  The
size of the mix follows the domain with the largest target weight, which is kept whole;
scarcer domains are repeated, up to MOST_COPIES times their tokens, and fall short of
their targets if that is not enough; what each domain has reached is part of the result.
A rate of 1.3 means one copy of the document and, for three documents in ten, a second one.
Only DataFrame functions and Spark ML are used.

The gradient of a rate depends on the document's chances alone, and so does the rate: it is
1, less the step times the gradient, cut off at the bounds.  One very long step is taken,
whose gradient is that at the rates it leads to (a backward step), so that no step size
has to be found and the rates are the least-squares ones up to one part in STEP.  The
step's gradient, a number for each domain, is found in rounds by Newton steps with the
small Gram matrix of the domains over the rates that are not at a bound, damped to
several degrees.  A round sums up all candidates at once over the distinct chances, in
thousandths, whose number does not grow with the documents; the sums are all that the
driver sees.  It never fails: it ends when the residual is small, when a round brings
nothing, or after ROUNDS, and gives the best rates with the residual that is left.

What a domain has in tokens is summed up from the unrounded chances, so that a rare
domain is not rounded away.

* Null or empty text: no tokens, a rate as its chances give.
* Null labels: the last domain.  No labels at all: all documents in one domain, rate 1.
* A domain without tokens cannot reach its target; the others do.
* Repeated rows with a key: the same rate and number of copies each.
* An empty table: no rows.
* Further columns are kept by ``mixed_documents``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, as_columns, stored, table
from .features import SAMPLE_ROWS, hashed, labelled_sample, words_of

# Domains by expressions over the labels, and the share of tokens each should have.
DOMAINS = {"toxic": "toxic = 1", "low": "quality = 0", "clean": "true"}
TARGETS = {"toxic": 0.02, "low": 0.06, "clean": 0.92}
# The mix takes this many times the tokens of the domain with the largest target.
REPEATS = 1.1
# No document has a higher rate than this, and no domain is asked for more of its tokens.
MOST_COPIES = 4.0
# Length of the step, most rounds, and the residual, as a share of what is wanted, to end at.
STEP = 1e6
ROUNDS = 40
CLOSE = 1e-6
# Candidates of a round: dampings of the Gram matrix, and shares of the Newton step.
DAMPINGS = (0.0, 1e-4, 1e-2, 0.3)
SHARES = (1.0, 0.5, 0.2, 0.05)


class Membership(NamedTuple):
    names: tuple[str, ...]
    model: LogisticRegressionModel | None  # None: all documents are of one domain
    only: int = 0


def fit_membership(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   domains: dict[str, str] = DOMAINS, rows: int = SAMPLE_ROWS) -> Membership:
    """The classifier, fitted on about ``rows`` labelled documents at most."""
    names = tuple(domains)
    domain = F.lit(len(names) - 1)
    for place, rule in reversed(list(enumerate(domains.values()))):
        domain = F.when(F.expr(rule), place).otherwise(domain)
    sample = stored(labelled_sample(docs, labels, key, text, rows).select(
        words_of(F.col("text")).alias("tokens"), domain.cast("double").alias("domain")),
        "mixing-sample")
    seen = [int(r[0]) for r in sample.select("domain").distinct().collect()]
    if len(seen) < 2:
        return Membership(names, None, seen[0] if seen else len(names) - 1)
    model = LogisticRegression(
        featuresCol="features", labelCol="domain", family="multinomial", regParam=2e-3,
        elasticNetParam=1.0, maxIter=30, probabilityCol="chances",
    ).fit(hashed("tokens", "features").transform(sample))
    return Membership(names, model)


def chances(docs: DataFrame, membership: Membership, keep: list[Column], text: str) -> DataFrame:
    """``keep``, n_tokens and the chance of each domain, in thousandths and unrounded."""
    n_tokens = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    n = len(membership.names)
    if membership.model is None:
        one = [1000 * (place == membership.only) for place in range(n)]
        return docs.select(*keep, n_tokens.alias("n_tokens"),
                           *(F.lit(v).alias(f"m_{d}") for v, d in zip(one, membership.names)),
                           *(F.lit(v / 1000).alias(f"c_{d}") for v, d in zip(one, membership.names)))
    rows = docs.select(*keep, n_tokens.alias("n_tokens"), words_of(F.col(text)).alias("mix_tokens"))
    model = membership.model.copy().setFeaturesCol("mix_features").setProbabilityCol("mix_chances")
    model = model.setRawPredictionCol("mix_raw").setPredictionCol("mix_domain")
    scored = model.transform(hashed("mix_tokens", "mix_features").transform(rows))
    # Generated as a row of its own, the chances of a text are computed once, however often
    # they are asked for afterwards.
    once = F.explode(F.array(vector_to_array("mix_chances"))).alias("mix_share")
    scored = scored.select(*(F.col(f"`{c}`") for c in rows.columns if c != "mix_tokens"), once)
    share = F.col("mix_share")
    seen = membership.model.numClasses
    whole = [share[place] if place < seen else F.lit(0.0) for place in range(n)]
    parts = [F.round(part * 1000).cast("int") for part in whole]
    return scored.select(*(F.col(f"`{c}`") for c in scored.columns if c != "mix_share"),
                         *(p.alias(f"m_{d}") for p, d in zip(parts, membership.names)),
                         *(p.alias(f"c_{d}") for p, d in zip(whole, membership.names)))


class Rates(NamedTuple):
    """What decides the rates, and what they lead to, by domain."""

    names: tuple[str, ...]
    step: tuple[float, ...]     # taken off a rate for a chance of 1
    have: tuple[float, ...]     # tokens in the documents
    wanted: tuple[float, ...]
    reached: tuple[float, ...]  # expected tokens in the mix
    residual: float             # of the step's equations, as a share of what is wanted
    rounds: int


def rate(rates: Rates) -> Column:
    """A document's rate, from its chances in thousandths."""
    return F.expr(bounded(linear(rates.names, [f"{v!r}D" for v in rates.step])))


def bounded(value: str) -> str:
    return f"least({MOST_COPIES}D, greatest(0.0D, {value}))"


def linear(names: tuple[str, ...], step: list[str]) -> str:
    return "1.0D" + "".join(f" - ({part}) * m_{name} / 1000.0D" for name, part in zip(names, step))


def _sums(kinds: DataFrame, names: tuple[str, ...], steps: list[np.ndarray]) -> list[tuple]:
    """(totals, potential, Gram matrix) at each step: one aggregation over all kinds, with
    one row for each step and task in the shuffle."""
    n, most = len(names), MOST_COPIES
    listed = ", ".join(f"struct({k} AS k, " + ", ".join(
        f"{float(v)!r}D AS v{d}" for d, v in enumerate(step)) + ")" for k, step in enumerate(steps))
    tried = kinds.selectExpr("*", f"inline(array({listed}))").selectExpr(
        "*", f"{linear(names, [f'v{d}' for d in range(n)])} AS value")
    tokens = " + ".join(f"t_{d}" for d in names)
    potential = (f"CASE WHEN value < 0 THEN 0.0D WHEN value < {most}D THEN value * value / 2"
                 f" ELSE {most}D * value - {most * most / 2}D END")
    sums = [*(f"{bounded('value')} * t_{d}" for d in names), f"({tokens}) * ({potential})",
            *(f"IF(value BETWEEN 0 AND {most}D, t_{d} * m_{e} / 1000.0D, 0.0D)"
              for d in names for e in names)]
    rows = tried.groupBy("k").agg(*(F.expr(f"sum({part})") for part in sums)).collect()
    return [(np.array(r[1:n + 1]), r[n + 1], np.array(r[n + 2:]).reshape(n, n)) for r in sorted(rows)]


def fit_rates(members: DataFrame, names: tuple[str, ...], targets: dict[str, float],
              repeats: float = REPEATS, rounds: int = ROUNDS, close: float = CLOSE) -> Rates:
    """The rates whose expected tokens are closest to the targets, a domain's gap counting
    by the inverse of the tokens it has."""
    own = [F.col(f"c_{d}") if f"c_{d}" in members.columns else F.col(f"m_{d}") / 1000 for d in names]
    kinds = stored(members.groupBy(*(f"m_{d}" for d in names)).agg(
        *(F.sum(F.col("n_tokens") * c).alias(f"t_{d}") for d, c in zip(names, own))), "mixing-kinds")
    n = len(names)
    row = kinds.agg(*(F.sum(f"t_{d}") for d in names)).first()
    have = np.array([v or 0.0 for v in row])
    there = [(targets[d], h) for h, d in zip(have, names) if h and targets[d]]
    if not there:
        none = tuple(have.tolist())
        return Rates(names, (0.0,) * n, none, none, none, 0.0, 0)
    # The domain to be kept whole; of equal targets, that with the most tokens.
    target, most = max(there)
    wanted = np.array([min(repeats * most / target * targets[d], MOST_COPIES * h)
                       for h, d in zip(have, names)])
    scale = 1 / np.sqrt(np.where(have > 0, have, 1.0))
    step = np.zeros(n)
    at = _sums(kinds, names, [step])[0]

    def gap(where: np.ndarray, sums: tuple) -> np.ndarray:
        return where / scale ** 2 / STEP - (sums[0] - wanted)

    def residual(where: np.ndarray, sums: tuple) -> float:
        return float(np.linalg.norm(gap(where, sums) * scale) / np.sqrt(wanted.sum()))

    def potential(where: np.ndarray, sums: tuple) -> float:
        return float((where ** 2 / scale ** 2).sum() / (2 * STEP) + wanted @ where + sums[1])

    done = 0
    for done in range(1, rounds + 1):
        if residual(step, at) <= close:
            done -= 1
            break
        gram = at[2] * np.outer(scale, scale) + np.eye(n) / STEP
        moves = [-scale * np.linalg.solve((gram + gram.T) / 2 + damping * np.eye(n),
                                          gap(step, at) * scale) for damping in DAMPINGS]
        tried = [step + share * move for move in moves for share in SHARES]
        sums = _sums(kinds, names, tried)
        nearest = min(range(len(tried)), key=lambda k: residual(tried[k], sums[k]))
        lowest = min(range(len(tried)), key=lambda k: potential(tried[k], sums[k]))
        if residual(tried[nearest], sums[nearest]) < 0.9 * residual(step, at):
            best = nearest
        elif potential(tried[lowest], sums[lowest]) < potential(step, at):
            best = lowest  # past a kink, at which the residual does not fall
        else:
            break
        step, at = tried[best], sums[best]
    return Rates(names, tuple(step.tolist()), tuple(have.tolist()), tuple(wanted.tolist()),
                 tuple(at[0].tolist()), residual(step, at), done)


def copies(of: Column, key: Column) -> Column:
    """Whole copies for a rate: the part after the point is drawn by the key's hash."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(of) + F.when(draw < of - F.floor(of), 1).otherwise(0)).cast("int")


def rated(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          domains: dict[str, str] = DOMAINS, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(key, n_tokens, m_domain of each, rate, copies, reached_domain of each) of every
    document; ``reached`` is the domain's share of what is wanted of it, 1 if on target."""
    membership = fit_membership(docs, labels, key, text, domains)
    members = stored(chances(docs, membership, [F.col(key)], text), "memberships")
    rates = fit_rates(members, membership.names, targets)
    shares = [F.lit(reached / wanted if wanted else 1.0).alias(f"reached_{d}")
              for d, reached, wanted in zip(rates.names, rates.reached, rates.wanted)]
    found = members.withColumn("rate", rate(rates))
    return found.select("*", copies(F.col("rate"), F.col(key)).alias("copies"), *shares)


def mixed_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    domains: dict[str, str] = DOMAINS,
                    targets: dict[str, float] = TARGETS) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns they have."""
    membership = fit_membership(docs, labels, key, text, domains)
    members = stored(chances(docs, membership, [F.col(key)], text).drop(key), "memberships")
    rates = fit_rates(members, membership.names, targets)
    own = F.struct(*as_columns(docs.columns)).alias("mix_row")
    again = chances(docs.withColumn("mix_row", own), membership,
                    [F.col("mix_row"), F.col(key).alias("mix_key")], text)
    taken = again.select("mix_row", copies(rate(rates), F.col("mix_key")).alias("n"))
    repeated = taken.filter("n > 0").select(
        "mix_row", F.explode(F.expr("sequence(1, n)")).alias("mix_copy"))
    return repeated.select(*(F.col("mix_row")[c].alias(c) for c in docs.columns))


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_tokens", *(
        (F.col(f"m_{d}") / 1000).alias(f"p_{d}") for d in DOMAINS), "rate", "copies",
        *(f"reached_{d}" for d in DOMAINS))
