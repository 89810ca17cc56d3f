"""Timings of the headline queries and of the bulk cleaning job.

Prints one JSON line.  Every query runs once to warm up and is then timed; all its
rows and columns are computed and dropped.  ``clean_csv_N`` is the whole cleaning job
on N synthetic posts: read CSV, clean, write Parquet, with a given schema and one line a row;
``clean_csv_default_N`` is the same without these settings; ``clean_only_N`` is the cleaning
of N posts from Parquet without the write.  Start-up of the session is reported apart.
``comparison`` sets the job beside a plain Python loop over the same posts in memory;
the speed-up is given only if both texts agree on every post.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import statistics
import tempfile
import time

from brevia.functions.emoji_names import VS16, default_names
from brevia.operators.cleaning import clean_file, clean_posts
from brevia.operators.parity import parity_check
from brevia.plans.queries import QUERIES
from brevia.session import local_session
from brevia.sources.readers import read_posts
from brevia.sources.synthetic import generate_posts
from brevia.sources.writers import write_csv, write_parquet

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "clean_text", "clean_passthrough", "handle_emojis", "remove_urls", "text_lengths",
    "noise_flags", "class_balance", "length_stats", "length_histogram", "noise_profile",
    "sample_per_class", "token_quantiles", "vocabulary", "encode_tokens", "eval_metrics",
    "confusion_matrix", "classification_report", "parity_check",
    "train_predict",
]
SIZES = [1_000, 10_000, 100_000, 1_000_000]
ROUNDS = 3


def timed(job) -> float:
    start = time.perf_counter()
    job()
    return time.perf_counter() - start


def drop_rows(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def python_cleaner(names):
    """The rules as a function of one text, for the comparison."""
    words = {**names.single, **names.joined}
    keys = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    emoji = re.compile(f"({keys}){VS16}?")
    marks = [(re.compile(p), by) for p, by in (
        (r"https?://\S+", "[URL]"), (r"^\s+|\s+$", ""), (r"@\w+", "@user"), (r"#(\w+)", r"\1"))]

    def clean(text: str) -> str:
        for pattern, by in marks:
            text = pattern.sub(by, text)
        return emoji.sub(lambda found: f":{words[found[1]]}:", text).lower()

    return clean


def comparison(spark, seconds: dict[str, float]) -> list[dict]:
    clean, rows = python_cleaner(default_names(spark)), []
    for n in SIZES[:3]:
        posts = generate_posts(spark, n)
        listed = [tuple(row) for row in posts.collect()]
        start = time.perf_counter()
        cleaned = [(i, clean(text)) for i, text in listed]
        loop = time.perf_counter() - start
        plain = spark.createDataFrame(cleaned, "id long, text_cleaned string")
        result = parity_check(plain, clean_posts(posts), "text_cleaned").first()
        spark_seconds = seconds[f"clean_csv_{n}"]
        rows.append({
            "rows": n, "python_seconds": round(loop, 3), "spark_seconds": round(spark_seconds, 3),
            "parity": result.all_match, "mismatches": result.mismatch_count,
            "speedup": round(loop / spark_seconds, 1) if result.all_match else None,
        })
    return rows


def cleaning_times(spark, folder: str) -> tuple[dict[str, float], dict[str, int]]:
    seconds, rates = {}, {}
    for n in SIZES:
        source, stored = f"{folder}/posts_{n}.csv", f"{folder}/posts_{n}.parquet"
        posts = generate_posts(spark, n).select("text")
        write_csv(posts, source)
        write_parquet(posts, stored)
        target = f"{folder}/clean_{n}.parquet"
        jobs = {
            f"clean_csv_{n}": lambda: clean_file(
                spark, source, target, mode="overwrite", schema="text STRING", multi_line=False),
            f"clean_csv_default_{n}": lambda: clean_file(spark, source, target, mode="overwrite"),
            f"clean_only_{n}": lambda: drop_rows(clean_posts(read_posts(spark, stored))),
        }
        for name, job in jobs.items():
            job()
            seconds[name] = statistics.median(timed(job) for _ in range(ROUNDS))
            rates[name] = round(n / seconds[name])
    return seconds, rates


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="brevia-bench-")
    start = time.perf_counter()
    spark = local_session(
        CPUS, int(CPUS), **{"spark.driver.memory": "16g", "spark.checkpoint.dir": scratch}
    )
    startup = time.perf_counter() - start
    queries = {}
    try:
        for name in HEADLINE:
            def job(query=QUERIES[name]):
                drop_rows(query(spark, SF_DIR))

            job()
            queries[name] = timed(job)
        cleaning, rates = cleaning_times(spark, scratch)
        compared = comparison(spark, cleaning)
    finally:
        spark.stop()
        shutil.rmtree(scratch, ignore_errors=True)
    queries.update(cleaning)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in queries.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS), "session_start_seconds": round(startup, 3),
        "posts_per_second": rates, "comparison": compared,
    }))


if __name__ == "__main__":
    main()
