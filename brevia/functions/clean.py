"""Cleaning rules as ``Column -> Column`` functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .emoji import handle_emojis
from .emoji_names import EmojiNames
from .patterns import HASHTAG, MENTION, URL, URL_TOKEN, USER_TOKEN, WHITESPACE

__all__ = [
    "clean_text", "handle_emojis", "normalize_hashtags", "remove_mentions", "remove_urls",
    "replace_markup", "replace_urls", "strip", "to_lowercase",
]


def strip(text: Column) -> Column:
    """Without white space at both ends.

    A character-set trim is used because a ``\\s+$`` pattern rescans every inner
    run of white space of a long text.
    """
    return F.btrim(text, F.lit(WHITESPACE))


def replace_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, URL_TOKEN)


def remove_urls(text: Column) -> Column:
    """Replace http(s) addresses by the URL token and strip both ends."""
    return strip(replace_urls(text))


def remove_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, USER_TOKEN)


def normalize_hashtags(text: Column) -> Column:
    """Drop the ``#`` in front of a word and keep the word."""
    return F.regexp_replace(text, HASHTAG, "$1")


def to_lowercase(text: Column) -> Column:
    return F.lower(text)


def replace_markup(text: Column) -> Column:
    """The pattern rules in order, null text as empty text."""
    return normalize_hashtags(remove_mentions(remove_urls(F.coalesce(text, F.lit("")))))


def clean_text(text: Column, names: EmojiNames | None = None) -> Column:
    """All rules: addresses, mentions, hashtags, emoji, lower case.

    The emoji step looks at its input several times; going through a one-element
    array makes that input be computed once.
    """
    marked = F.array(replace_markup(text))
    return F.get(F.transform(marked, lambda t: to_lowercase(handle_emojis(t, names))), F.lit(0))
