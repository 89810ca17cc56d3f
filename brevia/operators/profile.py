"""Profile of a labelled table: sizes, balance, lengths, noise, samples.

Length figures never carry one value per row through a shuffle: rows are first
counted by (split, metric, value) with a partial count on the map side.  What is
left per split is one row per distinct length, a number bounded by the longest
text and not by the number of posts, so a split that holds almost all rows is no
heavier than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import LABEL_NAMES, NOISE
from ..functions.text import label_name, n_chars, n_tokens, n_words, noise_flag

# Spark keeps a per-task top-k ahead of the shuffle for rank filters up to this size.
GROUP_LIMIT = 1000


def with_label_name(df: DataFrame) -> DataFrame:
    """Append the class name; a lookup in three constants, so no join."""
    return df.withColumn("label_name", label_name(F.col("label")))


def with_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return df.withColumns({"n_chars": n_chars(text), "n_words": n_words(text)})


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))


def class_balance(df: DataFrame) -> DataFrame:
    """Count and share in percent of each class in each split."""
    counts = with_label_name(df.groupBy("split", "label").agg(F.count("*").alias("n_rows")))
    total = F.sum("n_rows").over(Window.partitionBy("split"))
    share = F.col("n_rows").cast("double") / total * 100
    return counts.select("split", "label_name", "n_rows", share.alias("pct"))


def by_count(balance: DataFrame) -> DataFrame:
    """The classes of each split from the rarest to the most frequent, with their place."""
    place = F.row_number().over(Window.partitionBy("split").orderBy("n_rows", "label_name"))
    return balance.withColumn("place", place).orderBy("split", "place")


def value_counts(df: DataFrame, measures: dict[str, Column], *by: str) -> DataFrame:
    """(by..., metric, value, n): how often each value of each measure occurs."""
    pairs = F.array(*(
        F.struct(F.lit(name).alias("metric"), value.cast("long").alias("value"))
        for name, value in measures.items()
    ))
    return (
        df.select(*by, F.inline(pairs))
        .groupBy(*by, "metric", "value")
        .agg(F.count("*").alias("n"))
    )


def length_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return value_counts(df, {"chars": n_chars(text), "words": n_words(text)}, "split")


def length_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean, median, maximum and 95th percentile of the lengths of each split."""
    def only(metric: str, value) -> Column:
        return F.when(F.col("metric") == metric, value)

    def mean(metric: str) -> Column:
        return F.sum(only(metric, F.col("value") * F.col("n"))) / F.sum(only(metric, F.col("n")))

    def quantile(metric: str, p: float) -> Column:
        return F.percentile(only(metric, F.col("value")), F.lit(p), F.col("n"))

    rounded = {
        "chars_mean": mean("chars"), "chars_median": quantile("chars", 0.5),
        "chars_p95": quantile("chars", 0.95), "words_mean": mean("words"),
        "words_median": quantile("words", 0.5),
    }
    stats = {name: F.bround(value, 1).alias(name) for name, value in rounded.items()}
    return length_counts(df, text_col).groupBy("split").agg(
        stats["chars_mean"], stats["chars_median"],
        F.max(only("chars", F.col("value"))).alias("chars_max"),
        stats["chars_p95"], stats["words_mean"], stats["words_median"],
    )


def quantiles(counts: DataFrame, probabilities: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles with linear interpolation from value counts."""
    return counts.groupBy(*by).agg(*(
        F.percentile("value", F.lit(p), F.col("n")).alias(name)
        for name, p in probabilities.items()
    ))


def token_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Distribution of the number of tokens over all rows."""
    return value_counts(df, {"tokens": n_tokens(F.col(text_col))})


def token_quantiles(df: DataFrame, text_col: str = "text") -> DataFrame:
    return quantiles(token_counts(df, text_col), {"p95": 0.95, "p99": 0.99})


def _auto_bins(low: Column, high: Column, iqr: Column, n: Column) -> Column:
    """Number of bins by the narrower of the Freedman-Diaconis and Sturges widths,
    for whole numbers not below one."""
    spread = (high - low).cast("double")
    sturges = spread / (F.log2(n.cast("double")) + 1)
    diaconis = 2 * iqr / F.pow(n.cast("double"), F.lit(1.0 / 3))
    width = F.greatest(F.when(diaconis > 0, F.least(diaconis, sturges)).otherwise(sturges), F.lit(1.0))
    return F.when(spread > 0, F.ceil(spread / width)).otherwise(1).cast("long")


def histogram(counts: DataFrame, *by: str, bins: int | str = 20) -> DataFrame:
    """Equal-width bins over each group's [min, max], the last bin closed.

    ``counts`` has the columns (by..., metric, value, n).  Bin numbers come from
    whole-number arithmetic, so a value on an edge always falls to the upper bin.
    Empty bins are listed.  One range (min = max) is widened by a half each way.
    """
    group = Window.partitionBy(*by, "metric")
    value, n = F.col("value"), F.col("n")
    ranged = counts.select(
        *by, "metric", "value", "n",
        F.min("value").over(group).alias("low"), F.max("value").over(group).alias("high"),
        F.percentile("value", F.lit(0.5), n).over(group).alias("median"),
        *([F.sum("n").over(group).alias("total"),
           (F.percentile("value", F.lit(0.75), n).over(group)
            - F.percentile("value", F.lit(0.25), n).over(group)).alias("iqr")]
          if bins == "auto" else []),
    )
    low, high = F.col("low"), F.col("high")
    n_bins = (
        _auto_bins(low, high, F.col("iqr"), F.col("total")) if bins == "auto" else F.lit(int(bins))
    )
    flat = F.when(low == high, 1).otherwise(0)
    # Twice the bounds, so that the half of a widened range stays a whole number.
    low2, high2 = 2 * low - flat, 2 * high + flat
    offset = (2 * value - low2) * F.col("bins")
    binned = ranged.withColumn("bins", n_bins.cast("long")).withColumns({
        "bin": F.least(F.floor(offset / (high2 - low2)).cast("long"), F.col("bins") - 1),
        "start2": low2, "width2": (high2 - low2),
    })
    # The row of a group's minimum also brings the zero rows of all its bins.
    zeros = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("bins") - 1),
        lambda b: F.struct(b.alias("bin"), F.lit(0).cast("long").alias("n")),
    )
    own = F.array(F.struct(F.col("bin").alias("bin"), n.alias("n")))
    kept = [*by, "metric", "median", "bins", "start2", "width2"]
    edge = F.col("start2") / 2
    step = F.col("width2") / 2 / F.col("bins")
    return (
        binned.select(*kept, F.inline(F.when(value == low, F.concat(own, zeros)).otherwise(own)))
        .groupBy(*kept, "bin")
        .agg(F.sum("n").alias("n_rows"))
        .select(
            *by, "metric", "bin",
            (edge + F.col("bin") * step).alias("bin_start"),
            (edge + (F.col("bin") + 1) * step).alias("bin_end"),
            "n_rows", "median",
        )
    )


def length_histogram(df: DataFrame, text_col: str = "text", bins: int | str = 20) -> DataFrame:
    return histogram(length_counts(df, text_col), "split", bins=bins)


def token_histogram(df: DataFrame, text_col: str = "text", bins: int | str = "auto") -> DataFrame:
    return histogram(token_counts(df, text_col), bins=bins)


def with_noise_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.col(text_col)
    return df.withColumns({f"has_{p}": noise_flag(text, p) for p in NOISE})


def noise_profile(df: DataFrame, text_col: str = "text", split: str = "train") -> DataFrame:
    """Posts of one split that match each noise pattern, all counted in one pass."""
    text = F.col(text_col)
    totals = df.filter(F.col("split") == split).agg(
        F.count("*").alias("n_rows"), *(F.count_if(noise_flag(text, p)).alias(p) for p in NOISE)
    )
    rows = F.array(*(
        F.struct(F.lit(p).alias("pattern"), F.col(p).alias("occurrences")) for p in NOISE
    ))
    share = F.try_divide(F.col("occurrences").cast("double"), F.col("n_rows")) * 100
    return totals.select("n_rows", F.inline(rows)).select(
        "pattern", "occurrences", share.alias("pct")
    )


def _small_keys(rows: DataFrame, n: int) -> DataFrame:
    """The rows of each class whose key is below a bound that about n rows of it meet.

    The bound follows from the class's count, so that about n rows of a class are
    ranked, however many it has; it is raised until at least n are below it.
    """
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    slack = 1.2
    while True:
        bounds = {k: min(1.0, (slack * n + 100) / size) for k, size in sizes.items()}
        below = F.lit(False)
        for label, share in bounds.items():
            bound = "g" if share == 1.0 else f"{int(share * (1 << 48)):012x}"
            below = below | (F.col("label") == label) & (F.col("key") < bound)
        kept = rows.filter(below)
        got = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
        if all(got.get(k, 0) >= min(n, size) for k, size in sizes.items()):
            return kept
        slack *= 2


def choose_per_class(labelled: DataFrame, n: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(id, label, sample_rank) of ``n`` rows of each class in a seeded random order, all
    rows if a class has fewer; reads no text.

    Up to ``GROUP_LIMIT`` rows Spark cuts each task's input to its own first n before the
    shuffle.  For larger samples only rows with a small enough key are ranked.
    """
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    known = F.col("label").isin(*range(len(LABEL_NAMES)))
    rows = labelled.filter(known).select(id_col, "label", key.alias("key"))
    if n > GROUP_LIMIT:
        rows = _small_keys(rows, n)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("key", id_col))
    chosen = rows.withColumn("sample_rank", rank).filter(F.col("sample_rank") <= n)
    return chosen.select(id_col, "label", "sample_rank")


def sample_per_class(df: DataFrame, n: int = 5, seed: int = 42, id_col: str = "id",
                     labelled: DataFrame | None = None) -> DataFrame:
    """The rows of :func:`choose_per_class`, fetched by their ids, which must be unique.

    ``labelled`` has id and label if ``df`` does not, so that labels need not be joined
    to all texts first.  The ids of a small sample are broadcast; the join of a large
    one is left to the optimizer.
    """
    chosen = choose_per_class(df if labelled is None else labelled, n, seed, id_col)
    if labelled is None:
        chosen = chosen.drop("label")
    if n <= GROUP_LIMIT:
        chosen = F.broadcast(chosen)
    return with_label_name(df.join(chosen, id_col))


def head_rows(df: DataFrame, n: int = 5, id_col: str = "id") -> DataFrame:
    """The first ``n`` rows by id.

    The ids are found alone, each task keeping only its own first n; what belongs to
    them is read again, so nothing but ids is sorted and shuffled.
    """
    first = df.select(id_col).orderBy(id_col).limit(n)
    return df.join(F.broadcast(first.distinct()), id_col, "left_semi").orderBy(id_col).limit(n)
