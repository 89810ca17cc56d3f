"""Text measures, previews, noise flags and class names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import LABEL_NAMES, NOISE, NOISE_GATES, TOKEN, WORD


def n_chars(text: Column) -> Column:
    """Length in code points; null counts as empty."""
    return F.length(F.coalesce(text, F.lit("")))


def n_words(text: Column) -> Column:
    """Number of runs without white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def tokens(text: Column) -> Column:
    """Words and single other visible characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def preview(text: Column, width: int = 150) -> Column:
    """The first ``width`` characters, with dots only if something was left out."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)


def mismatch_preview(text: Column, width: int = 80) -> Column:
    """The first ``width`` characters, always followed by dots."""
    return F.concat(F.substring(text, 1, width), F.lit("..."))


def percent_text(share: Column) -> Column:
    """A percentage for display, e.g. ``12.5%``, halves to the even digit."""
    return F.format_string("%.1f%%", F.bround(share, 1))


def title_text(word: Column) -> Column:
    return F.initcap(word)


def banner_text(word: Column) -> Column:
    return F.upper(word)


def noise_flag(text: Column, pattern: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    flag = text.rlike(NOISE[pattern])
    gate = NOISE_GATES.get(pattern)
    return text.rlike(gate) & flag if gate else flag


def label_name(label: Column) -> Column:
    """Class name of a label id, null for an id outside the list."""
    return F.get(F.array(*map(F.lit, LABEL_NAMES)), label.cast("int"))


def label_id(name: Column) -> Column:
    position = F.array_position(F.array(*map(F.lit, LABEL_NAMES)), name)
    return F.nullif(position, F.lit(0)).cast("int") - 1


def argmax(scores: Column) -> Column:
    """Index of the highest score, the lowest index if several are equal."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
