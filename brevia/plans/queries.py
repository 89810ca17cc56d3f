"""One registered query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, text
from ..functions.patterns import NOISE
from ..operators import metrics, model, parity, profile, tokens
from ..operators.cleaning import clean_file, clean_posts
from ..operators.mapping import map_batches
from ..sources.checked_csv import RECORD, quarantine_broken, read_records
from ..sources.positions import INDEX, load_numbered_splits
from ..sources.readers import load_splits, read_posts
from ..sources.writers import scratch_path, write_csv, write_parquet
from ..streaming.cleaning import clean_stream
from .derived import (
    CSV_LINE, EMOJI_TEXT, SOME_IDS, SOME_TEXT, SPLITS, bucketed_posts, documents, labels,
    post_labels, post_texts, posts, with_label, with_scores,
)

Query = Callable[[SparkSession, str], DataFrame]
# Quotients are compared after rounding, as engines may add in another order.
DIGITS = 10
VOCABULARY_SIZE = 50_000


def _on_text(rule, name: str) -> Query:
    return lambda spark, sf: post_texts(spark, sf).select("id", rule(F.col("text")).alias(name))


def _in_split(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _as_text(column: str):
    return F.array_join(F.col(column), " ").alias(column)


# Sources and sinks -----------------------------------------------------------

def stored_splits(spark: SparkSession, sf: str, in_order: bool = False) -> dict[str, str]:
    """Write the posts with one folder per split; the paths of the folders.  If
    ``in_order``, files and the rows in them follow the ids."""
    path, table = scratch_path(spark, "posts"), bucketed_posts(spark, sf)
    if in_order:
        table = table.repartitionByRange("id").sortWithinPartitions("split", "id")
    write_parquet(table, path, by_split=True)
    return {name: f"{path}/split={name}" for name in SPLITS}


def q_load_splits(spark, sf):
    return load_splits(spark, stored_splits(spark, sf), "parquet").select(
        "id", "label", "split", "text"
    )


def q_csv_round_trip(spark, sf):
    path = scratch_path(spark, "union") + ".csv"
    write_csv(profile.with_label_name(posts(spark, sf)).drop("split"), path)
    schema = "id BIGINT, label INT, text STRING, label_name STRING"
    return read_posts(spark, path, schema=schema)


def q_csv_broken_rows(spark, sf):
    """Every document as a CSV row, some of them broken: the good rows and, from the
    quarantine, the broken ones as they stand in the file."""
    path, apart = scratch_path(spark, "lines"), scratch_path(spark, "broken")
    documents(spark, sf).selectExpr(f"{CSV_LINE} AS line").write.text(path)
    records = read_records(spark, path, "id BIGINT, n_chars BIGINT, lang STRING, text STRING", header=False)
    good, counts = quarantine_broken(records, apart)
    broken = read_posts(spark, apart, "parquet").select(RECORD)
    return good.unionByName(broken, allowMissingColumns=True).select(
        "id", "n_chars", "lang", "text", RECORD, F.lit(counts.good).cast("long").alias("n_good"),
        F.lit(counts.broken).cast("long").alias("n_broken"))


def q_union_splits(spark, sf):
    """All splits, numbered in the order of splits, files and rows in a file."""
    return load_numbered_splits(spark, stored_splits(spark, sf, in_order=True), "parquet")


def q_head_in_file_order(spark, sf):
    numbered = load_numbered_splits(spark, stored_splits(spark, sf, in_order=True), "parquet")
    return numbered.filter(F.col(INDEX) < 5).select(INDEX, "id", "label", "split", "text")


# Projections and text rules --------------------------------------------------

def q_clean_text(spark, sf):
    return clean_posts(post_texts(spark, sf)).select("id", "text_cleaned")


def q_clean_passthrough(spark, sf):
    target = scratch_path(spark, "cleaned") + ".parquet"
    clean_file(spark, f"{sf}/documents.parquet", target)
    return read_posts(spark, target)


def q_clean_csv(spark, sf):
    """The cleaning job from CSV to Parquet over whole texts; every column keeps its type
    and values.  Null and empty texts stand in a column of their own."""
    source, target = scratch_path(spark, "posts") + ".csv", scratch_path(spark, "cleaned") + ".parquet"
    joined = documents(spark, sf).join(labels(spark, sf).withColumnRenamed("id", "doc_id"),
                                       "doc_id", "left")
    write_csv(joined.select("doc_id", F.col("text").alias("body"),
                            F.expr(SOME_TEXT).alias("some_text"), "lang", "n_chars", "quality"), source)
    clean_file(spark, source, target, "body")
    return read_posts(spark, target)


def q_clean_nulls(spark, sf):
    some = documents(spark, sf).selectExpr("doc_id AS id", f"{SOME_TEXT} AS body")
    return clean_posts(some, "body").select("id", "body_cleaned")


def q_clean_stream(spark, sf):
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "cleaned")
    table = post_texts(spark, sf).select("id", "text")
    write_parquet(table, source)
    clean_stream(spark, source, table.schema, target, scratch_path(spark, "offsets")
                 ).awaitTermination()
    return spark.read.parquet(target).select("id", "text_cleaned")


def q_emoji_fixture(spark, sf):
    other = documents(spark, sf).selectExpr("doc_id AS id", f"{EMOJI_TEXT} AS text")
    return other.select("id", clean.handle_emojis(F.col("text")).alias("text"))


def q_preview(spark, sf):
    return post_texts(spark, sf).select(
        "id", text.preview(F.col("text")).alias("preview"),
        text.mismatch_preview(F.col("text")).alias("mismatch_preview"),
    )


def q_text_lengths(spark, sf):
    return profile.with_lengths(post_texts(spark, sf)).select("id", "n_chars", "n_words")


def q_noise_flags(spark, sf):
    return profile.with_noise_flags(post_texts(spark, sf)).select(
        "id", *(f"has_{p}" for p in NOISE)
    )


def q_batch_map(spark, sf):
    def lengths(batch):
        return batch[["text"]].assign(n_points=batch["text"].str.len())

    return map_batches(post_texts(spark, sf), lengths, "n_points BIGINT", ["text"])


# Tokens ----------------------------------------------------------------------

def q_token_counts(spark, sf):
    return post_texts(spark, sf).select("id", text.n_tokens(F.col("text")).alias("n_tokens"))


def _vocabulary(spark, sf, size=VOCABULARY_SIZE):
    return tokens.build_vocabulary(_in_split(post_texts(spark, sf), "train"), size)


def _stored_vocabulary(spark, sf):
    path = scratch_path(spark, "vocabulary")
    tokens.save_vocabulary(_vocabulary(spark, sf), path)
    return tokens.load_vocabulary(spark, path)


def q_encode_tokens(spark, sf):
    encoded = tokens.encode(post_texts(spark, sf), _stored_vocabulary(spark, sf))
    return with_label(spark, sf, encoded).select(
        "id", "label", "split", _as_text("input_ids"), _as_text("attention_mask"))


# Profile ---------------------------------------------------------------------

def q_sample_per_class(spark, sf):
    return _sample(spark, sf, 5)


def _sample(spark, sf, n):
    labelled = _in_split(post_labels(spark, sf), "train")
    sampled = profile.sample_per_class(post_texts(spark, sf), n, labelled=labelled)
    return sampled.select("id", "label_name", "sample_rank", text.preview(F.col("text")).alias("text"))


def _first_test_rows(spark, sf):
    """The first 1,000 rows of the test split, scored after they are chosen."""
    rows = profile.head_rows(_in_split(post_texts(spark, sf), "test"), 1000)
    return with_label(spark, sf, metrics.with_prediction(with_scores(rows)).drop("text"))


def q_eval_subset(spark, sf):
    return _first_test_rows(spark, sf).select("id", "label", "pred")


# Measures --------------------------------------------------------------------

def _predicted(spark, sf):
    """Scored before the labels are joined, so that no text is shuffled."""
    scored = metrics.with_prediction(with_scores(post_texts(spark, sf))).drop("text")
    return with_label(spark, sf, scored)


def q_eval_metrics(spark, sf):
    return _rounded(metrics.evaluate(_predicted(spark, sf)), "accuracy", "f1_macro")


def _report(df):
    return _rounded(metrics.classification_report(df), "precision", "recall", "f1_score")


def q_baseline_report(spark, sf):
    return _report(_first_test_rows(spark, sf))


def _two_outputs(spark, sf):
    """The cleaned posts, and the same without the emoji step; some have no key."""
    table = post_texts(spark, sf).withColumn("id", F.expr(SOME_IDS))
    plain = table.select("id", F.lower(clean.replace_markup(F.col("text"))).alias("text_cleaned"))
    return clean_posts(table), plain


def q_parity_check(spark, sf):
    return parity.parity_check(*_two_outputs(spark, sf), "text_cleaned")


def _stored_outputs(spark, sf):
    """Two outputs of the posts in the order of their ids, stored without the ids: the
    cleaned posts, and the same without the emoji step."""
    table = post_texts(spark, sf).repartitionByRange("id").sortWithinPartitions("id")
    plain = F.lower(clean.replace_markup(F.col("text"))).alias("text_cleaned")
    paths = []
    for df in (clean_posts(table).select("text_cleaned"), table.select(plain)):
        paths.append(scratch_path(spark, "output"))
        write_parquet(df, paths[-1])
    return [read_posts(spark, path, "parquet") for path in paths]


def q_parity_by_position(spark, sf):
    return parity.parity_by_position(*_stored_outputs(spark, sf), "text_cleaned")


def q_position_mismatches(spark, sf):
    return parity.position_mismatches(*_stored_outputs(spark, sf), "text_cleaned")


def q_parity_mismatches(spark, sf):
    return parity.parity_mismatches(*_two_outputs(spark, sf), "text_cleaned")


# Model -----------------------------------------------------------------------

def q_train_predict(spark, sf):
    table = bucketed_posts(spark, sf)
    path = scratch_path(spark, "model")
    model.train(table, path)
    predicted = model.predict(model.load(path), _in_split(table, "test"))
    best = F.element_at("scores", F.col("pred") + 1)
    return predicted.select("id", "label", "pred", best.alias("score"))


def q_model_selection(spark, sf):
    table = bucketed_posts(spark, sf)
    _, history = model.select_model(
        _in_split(table, "train"), _in_split(table, "validation")
    )
    return spark.createDataFrame(
        history, "reg_param DOUBLE, accuracy DOUBLE, f1_macro DOUBLE, improved BOOLEAN"
    )


QUERIES: dict[str, Query] = {
    "load_splits": q_load_splits,
    "csv_round_trip": q_csv_round_trip,
    "union_splits": q_union_splits,
    "head_in_file_order": q_head_in_file_order,
    "csv_broken_rows": q_csv_broken_rows,
    "split_filter": lambda spark, sf: _in_split(bucketed_posts(spark, sf), "train"),
    "label_names": lambda spark, sf: profile.with_label_name(post_labels(spark, sf)),
    "clean_text": q_clean_text,
    "clean_passthrough": q_clean_passthrough,
    "clean_nulls": q_clean_nulls,
    "clean_csv": q_clean_csv,
    "clean_stream": q_clean_stream,
    "remove_urls": _on_text(clean.remove_urls, "text"),
    "remove_mentions": _on_text(clean.remove_mentions, "text"),
    "normalize_hashtags": _on_text(clean.normalize_hashtags, "text"),
    "to_lowercase": _on_text(clean.to_lowercase, "text"),
    "handle_emojis": _on_text(clean.handle_emojis, "text"),
    "emoji_fixture": q_emoji_fixture,
    "preview": q_preview,
    "text_lengths": q_text_lengths,
    "noise_flags": q_noise_flags,
    "batch_map": q_batch_map,
    "token_counts": q_token_counts,
    "vocabulary": _vocabulary,
    "encode_tokens": q_encode_tokens,
    "token_frequencies": lambda spark, sf: tokens.token_frequencies(
        _in_split(post_texts(spark, sf), "train")),
    "split_counts": lambda spark, sf: profile.split_counts(post_labels(spark, sf)),
    "class_balance": lambda spark, sf: profile.class_balance(post_labels(spark, sf)),
    "classes_by_count": lambda spark, sf: profile.by_count(
        profile.class_balance(post_labels(spark, sf))),
    "length_stats": lambda spark, sf: profile.length_stats(post_texts(spark, sf)),
    "length_histogram": lambda spark, sf: profile.length_histogram(post_texts(spark, sf)),
    "token_quantiles": lambda spark, sf: profile.token_quantiles(post_texts(spark, sf)),
    "token_histogram": lambda spark, sf: profile.token_histogram(post_texts(spark, sf)),
    "noise_profile": lambda spark, sf: profile.noise_profile(post_texts(spark, sf)),
    "sample_per_class": q_sample_per_class,
    "sample_2000_per_class": lambda spark, sf: _sample(spark, sf, 2000),
    "head_rows": lambda spark, sf: with_label(
        spark, sf, profile.head_rows(post_texts(spark, sf))),
    "eval_subset": q_eval_subset,
    "argmax_pred": lambda spark, sf: _predicted(spark, sf).select("id", "label", "pred"),
    "eval_metrics": q_eval_metrics,
    "confusion_matrix": lambda spark, sf: metrics.confusion_matrix(_predicted(spark, sf)),
    "classification_report": lambda spark, sf: _report(_predicted(spark, sf)),
    "baseline_report": q_baseline_report,
    "parity_check": q_parity_check,
    "parity_mismatches": q_parity_mismatches,
    "parity_by_position": q_parity_by_position,
    "position_mismatches": q_position_mismatches,
    "train_predict": q_train_predict,
    "model_selection": q_model_selection,
}
