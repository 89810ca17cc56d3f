"""Emoji to ``:name:`` text as one native column expression.

A text is cut into emoji and the text between them, each emoji is replaced by
its name, and the pieces are joined again.  Everything stays in the JVM and on
the row, so there is no shuffle and no Python worker.  Texts without any emoji
candidate skip all of it.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .emoji_names import REGIONAL_A, TONES, VS16, ZWJ, EmojiNames, default_names

# Blocks that hold emoji; a code point in them without a name is left as it is.
_BLOCKS = r"\x{203C}-\x{303D}\x{3297}-\x{3299}\x{1F004}-\x{1FAFF}\x{A9}\x{AE}"
# Most text between emoji.  Java is slow on classes of several ranges, so this class of
# two is tried before "anything outside the blocks".
_COMMON = r"\x00-\x{A8}\x{AF}-\x{203B}"
# First bytes in UTF-8 of the code points in the blocks: most emoji, and the others.
_LEAD = "F09F"
_OTHER_LEADS = ("E2", "E380", "E38A", "C2A9", "C2AE")
_KEYCAP_MARK = "⃣"
_KEYCAP = r"([0-9#*])\x{FE0F}?\x{20E3}"
_TONE = r"[\x{1F3FB}-\x{1F3FF}]"
_REGION = r"[\x{1F1E6}-\x{1F1FF}]"
_ASTRAL = 0x1F000
# A name and the trait at its end that a skin tone is put ahead of.
_TRAIT = r"^(.*?)(_beard|_[a-z]+_hair|_bald)?$"


def _points(chars) -> str:
    return "".join(rf"\x{{{ord(c):X}}}" for c in sorted(chars))


def _joined_pattern(names: EmojiNames) -> str:
    """Alternatives for all joined sequences, grouped by the set of endings a
    first symbol can have, longest ending first."""
    endings = defaultdict(set)
    for sequence in names.joined:
        endings[sequence[0]].add(sequence[1:])
    firsts = defaultdict(list)
    for first, rest in endings.items():
        firsts[tuple(sorted(rest, key=lambda r: (-len(r), r)))].append(first)
    loose = rf"(?:\x{{FE0F}}|{_TONE})?"
    branches = []
    for rest, heads in firsts.items():
        tails = "|".join(
            "".join(_points(c) + ("" if c == ZWJ else loose) for c in ending) for ending in rest
        )
        branches.append(rf"[{_points(heads)}]{loose}(?:{tails})")
    return "|".join(branches)


def _pieces_pattern(names: EmojiNames) -> str:
    """Runs of other text, or one emoji with all that belongs to it.

    The first two branches take nearly everything; look-aheads keep the classes and
    lists of many members from being tried where they cannot match.
    """
    alone = rf"(?![\x{{FE0F}}\x{{200D}}])(?!{_REGION})(?!{_TONE})(?!\x{{E0067}})"
    joined = rf"(?=.(?:\x{{FE0F}}|{_TONE})?[\x{{200D}}\x{{E0067}}])(?:{_joined_pattern(names)})"
    return "|".join([
        rf"[{_COMMON}]+",
        rf"[\x{{1F004}}-\x{{1FAFF}}]{alone}",
        rf"[^{_BLOCKS}]+",
        joined,
        rf"{_REGION}{{2}}",
        rf"(?=.{_TONE})[{_points(names.tonable)}]{_TONE}",
        rf"[{_BLOCKS}]\x{{FE0F}}?",
    ])


def _name_list(values) -> Column:
    return F.split(F.lit("|".join(values)), r"\|")


def _single_name(char: Column, names: EmojiNames) -> Column:
    low = sorted(c for c in names.single if ord(c) < _ASTRAL)
    high = [names.single.get(chr(point), "") for point in range(_ASTRAL, 0x1FB00)]
    point = F.ascii(char)
    at = F.instr(F.lit("".join(low)), char)
    return F.when(
        point >= _ASTRAL, F.get(_name_list(high), point - _ASTRAL)
    ).otherwise(F.get(_name_list(names.single[c] for c in low), at - 1))


def _region_name(pair: Column, names: EmojiNames) -> Column:
    letters = [chr(65 + i) for i in range(26)]
    listed = _name_list(names.regions.get(a + b, "") for a in letters for b in letters)
    first, second = (F.ascii(F.substring(pair, at, 1)) - REGIONAL_A for at in (1, 2))
    return F.get(listed, first * 26 + second)


def _joined_name(sequence: Column, names: EmojiNames) -> Column:
    listed = "|".join(f"{parts}={name}" for parts, name in names.joined.items())
    return F.element_at(F.str_to_map(F.lit(listed), F.lit(r"\|"), F.lit("=")), sequence)


def _toned(name: Column, piece: Column, names: EmojiNames) -> Column:
    """The name with the skin tones of the piece, ahead of a trait such as hair."""
    listed = _name_list("_" + names.single[t] for t in TONES)
    tones = F.array_distinct(F.regexp_extract_all(piece, F.lit(_TONE), 0))
    shown = F.transform(tones, lambda t: F.get(listed, F.ascii(t) - ord(TONES[0])))
    tone = F.array_join(shown, "")
    return F.regexp_replace(name, F.lit(_TRAIT), F.concat(F.lit("$1"), tone, F.lit("$2")))


def _colons(name: Column, piece: Column) -> Column:
    return F.coalesce(F.concat(F.lit(":"), F.nullif(name, F.lit("")), F.lit(":")), piece)


def _spoken(piece: Column, names: EmojiNames) -> Column:
    """The text for one piece, the frequent cases first."""
    bare = F.translate(piece, VS16 + TONES, "")
    sequence = (
        F.when(F.length(bare) == 1, _single_name(bare, names))
        .when(bare.rlike(f"^{_REGION}"), _region_name(bare, names))
        .otherwise(_joined_name(bare, names))
    )
    return (
        F.when(F.ascii(piece) < 0xA9, piece)
        .when(F.length(piece) == 1, _colons(_single_name(piece, names), piece))
        .when(~piece.rlike(f"^[{_BLOCKS}]"), piece)
        .otherwise(_colons(_toned(sequence, piece, names), piece))
    )


def may_hold_emoji(text: Column) -> Column:
    """False for nearly all texts without emoji, at the cost of a few byte searches."""
    raw = text.cast("binary")

    def holds(lead: str) -> Column:
        return F.contains(raw, F.lit(bytes.fromhex(lead)))

    others = reduce(Column.__or__, map(holds, _OTHER_LEADS))
    return holds(_LEAD) | (others & text.rlike(f"[{_BLOCKS}]"))


def handle_emojis(text: Column, names: EmojiNames | None = None) -> Column:
    """Each emoji becomes ``:name:``; a joined sequence, a flag and an emoji with
    skin tone or variation selector count as one."""
    names = names or default_names(SparkSession.active())
    keyed = F.when(
        text.contains(_KEYCAP_MARK), F.regexp_replace(text, _KEYCAP, ":keycap_$1:")
    ).otherwise(text)
    pieces = F.regexp_extract_all(keyed, F.lit(_pieces_pattern(names)), 0)
    named = F.transform(pieces, lambda piece: _spoken(piece, names))
    return F.when(may_hold_emoji(text), F.array_join(named, "")).otherwise(text)
