"""Secret scans over the history of a store, with an incremental blob ledger.

Every version of a file is addressed by its content (SHA-256).  The ledger records
which rules have been run on which blob and what they found.  A scan takes only the
pairs of blob and rule version that the ledger lacks, and findings are joined back to
every path that has had the blob.  Only DataFrame functions are used.

* Null text: the empty blob.  Null path: a path like any other.
* Repeated rows and equal texts: one blob, scanned once, reported for each row.
* An empty table: no blobs, no rows.
* Columns beside the path and the text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import scratch_path
from .common import table


class Rule(NamedTuple):
    """A pattern; a match counts if its group ``value`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    value: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Runs of one class are cut to their least length in the pattern, which finds the same
# runs as any length and a filter; an assignment that is too short still uses up its text.
BASE_RULES = (
    Rule("assign", 1, r"((?i)password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                      r"([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("key_block", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", 1, r"://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]{4,}@"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<start:int,place:int,end:int,kind:string>"
NO_SPANS = f"CAST(array() AS array<{SPAN}>)"
LEDGER = f"blob_id BINARY, rules ARRAY<STRING>, spans ARRAY<{SPAN}>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans(text: Column, rule: Rule, place: int) -> Column:
    """Where a rule matches, in code points: the pieces between matches and the matches
    themselves, in turn, give each match's start."""
    pattern = F.lit(rule.pattern)
    rows = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"),
        F.regexp_extract_all(text, pattern, F.lit(rule.value)).alias("value"),
    )

    def step(done: Column, row: Column) -> Column:
        start = done["at"] + F.length(row["gap"])
        end = start + F.length(row["found"])
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), end.alias("end"),
                        F.lit(rule.kind).alias("kind"))
        counts = F.length(row["value"]) >= rule.least
        return F.struct(
            F.coalesce(end, done["at"]).alias("at"),
            F.when(counts, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
            .alias("spans"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr(NO_SPANS).alias("spans"))
    found = F.aggregate(rows, start, step, lambda done: done["spans"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.expr(NO_SPANS))


def empty_ledger(spark: SparkSession) -> DataFrame:
    columns = [part.split(" ", 1) for part in LEDGER.split(", ", 2)]
    return spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in columns))


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules=RULES,
                text: str = "text") -> DataFrame:
    """Ledger rows for the blobs of ``versions`` that lack one of the rules."""
    wanted = F.array(*(F.lit(rule.name) for rule in rules))
    blobs = versions.select(blob_id(F.col(text)).alias("blob_id"),
                            F.coalesce(F.col(text), F.lit("")).alias("blob"))
    # One row for each blob and task is sent, so a blob with very many copies is no load.
    blobs = blobs.dropDuplicates(["blob_id"])
    done = ledger.groupBy("blob_id").agg(
        F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done")
    )
    todo = blobs.join(done, "blob_id", "left").withColumn(
        "rules", F.array_except(wanted, F.coalesce("done", F.expr("CAST(array() AS array<string>)")))
    ).filter(F.size("rules") > 0)
    found = [
        F.when(F.array_contains("rules", rule.name), spans(F.col("blob"), rule, place))
        .otherwise(F.expr(NO_SPANS))
        for place, rule in enumerate(rules)
    ]
    return todo.select("blob_id", "rules", F.flatten(F.array(*found)).alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules=RULES, text: str = "text",
                  first: bool = False) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the whole ledger."""
    spark = versions.sparkSession
    ledger = empty_ledger(spark) if first else spark.read.schema(LEDGER).parquet(path)
    scan_unseen(versions, ledger, rules, text).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, path: str = "doc_id",
             text: str = "text") -> DataFrame:
    """(path, spans) of each row: the blob's spans by start, then order of the rules."""
    found = ledger.filter(F.size("spans") > 0).groupBy("blob_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")
    )
    paths = versions.select(F.col(path), blob_id(F.col(text)).alias("blob_id"))
    return paths.join(found, "blob_id", "left").select(
        path, F.lower(F.hex("blob_id")).alias("blob_id"),
        F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"),
    )


def joined(spans_column: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(
        spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = update_ledger(docs, scratch_path(spark, "blob-ledger"), first=True)
    found = findings(docs, ledger)
    kinds = [rule.kind for rule in BASE_RULES]

    def of(*names: str) -> Column:
        return F.filter("spans", lambda span: span["kind"].isin(*names))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(joined(of(*kinds)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), "blob_id",
    )
