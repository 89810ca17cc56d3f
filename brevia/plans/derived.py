"""Labelled posts derived from the given tables.

Every document becomes one post with its whole text; a mention, a hashtag, emoji,
an address and sometimes a retweet mark are put around it, chosen by the hex
digits of a digest of its id.  The expressions below are valid in Spark SQL and
in DuckDB, so queries and checks share them word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread
from ..sources.tables import read_table, save_bucketed

# Emoji put into the posts, by hex digit; digits not listed get none.
POST_EMOJIS = {
    "0": "😊", "1": "🔥🔥", "2": "😢", "3": "❤️", "4": "👍🏽", "5": "🇧🇷", "6": "👩‍💻",
    "7": "👨‍👩‍👧", "8": "1️⃣", "9": "🎉🎊", "a": "🤔", "b": "😂💯",
}
POST_EMOJI_NAMES = {
    "👨‍👩‍👧": "family_man_woman_girl", "👩‍💻": "woman_technologist",
    "👍🏽": "thumbs_up_medium_skin_tone", "1️⃣": "keycap_1", "❤️": "red_heart", "🇧🇷": "Brazil",
    "😊": "smiling_face_with_smiling_eyes", "🔥": "fire", "😢": "crying_face",
    "🎉": "party_popper", "🎊": "confetti_ball", "🤔": "thinking_face",
    "😂": "face_with_tears_of_joy", "💯": "hundred_points",
}
# A second set for the emoji check on its own.
OTHER_EMOJIS = {
    "0": "😍", "1": "☕", "2": "🏀👀", "3": "🙏🏿", "4": "🇵🇹🇺🇸", "5": "🤷‍♀️", "6": "🏳️‍🌈", "7": "😩",
    "8": "#️⃣", "9": "👩🏾‍🚀", "a": "😘", "b": "🧔🏻‍♂️", "c": "©", "d": "✅", "e": "👩‍❤️‍👨",
}
OTHER_EMOJI_NAMES = {
    "👩‍❤️‍👨": "couple_with_heart_woman_man", "🧔🏻‍♂️": "man_light_skin_tone_beard",
    "👩🏾‍🚀": "woman_astronaut_medium-dark_skin_tone", "🏳️‍🌈": "rainbow_flag",
    "🤷‍♀️": "woman_shrugging", "🙏🏿": "folded_hands_dark_skin_tone", "#️⃣": "keycap_#",
    "🇵🇹": "Portugal", "🇺🇸": "United_States", "😍": "smiling_face_with_heart-eyes",
    "☕": "hot_beverage", "🏀": "basketball", "👀": "eyes", "😩": "weary_face",
    "😘": "face_blowing_a_kiss", "©": "copyright", "✅": "check_mark_button",
}

SPLITS = ("train", "validation", "test")


def digit(n: int) -> str:
    """The n-th hex digit of the digest of a document's id."""
    return f"substring(md5(CAST(doc_id AS STRING)), {n}, 1)"


def emoji_choice(n: int, emojis: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{emoji}'" for key, emoji in emojis.items())
    return f"CASE {digit(n)} {cases} ELSE '' END"


POST_TEXT = (
    f"concat('  ', CASE WHEN {digit(2)} < '4' THEN 'RT ' ELSE '' END,"
    f" '@', CASE WHEN {digit(3)} < '4' THEN 'user' ELSE source END, ' ', text,"
    f" ' #', lang, '_', {digit(4)}, ' ', {emoji_choice(5, POST_EMOJIS)},"
    f" CASE WHEN {digit(6)} < 'c' THEN concat(' https://ex.com/', CAST(doc_id AS STRING), '#x@y')"
    " ELSE '' END)"
)
EMOJI_TEXT = f"concat(text, ' ', {emoji_choice(7, OTHER_EMOJIS)}, '.')"
SPLIT = (
    f"CASE WHEN {digit(1)} < 'c' THEN 'train' WHEN {digit(1)} = 'c' THEN 'validation'"
    " ELSE 'test' END"
)
LABEL = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END"
# The whole text but for a few documents: none for one in sixteen, an empty one for another.
SOME_TEXT = f"CASE {digit(8)} WHEN '0' THEN NULL WHEN '1' THEN '' ELSE text END"
# A document's line of a CSV file; some lines have a field too many, some one too few, and
# some a number that is none.
CSV_LINE = (
    f"concat(CAST(doc_id AS STRING), ',', CASE WHEN {digit(9)} = '2' THEN 'x' ELSE '' END,"
    f" coalesce(CAST(n_chars AS STRING), ''),"
    f" CASE WHEN {digit(9)} = '1' THEN '' ELSE concat(',', coalesce(lang, '')) END,"
    " ',\"', replace(coalesce(text, ''), '\"', '\"\"'), '\"',"
    f" CASE WHEN {digit(9)} = '0' THEN ',more' ELSE '' END)"
)
LINE_IS_BROKEN = f"{digit(9)} IN ('0', '1', '2')"
# Ids of which some are missing, for the comparisons by key.
SOME_IDS = f"CASE WHEN {digit(8).replace('doc_id', 'id')} = '0' THEN NULL ELSE id END"


def _letters(letter: str) -> str:
    return f"CAST(length(text) - length(replace(text, '{letter}', '')) AS DOUBLE)"


# Three whole-number scores per post that both engines compute exactly, in place of
# a model's output: how often each of three letters occurs.
SCORES = [_letters(letter) for letter in ("i", "a", "o")]

POST_COLUMNS = ["doc_id AS id", f"{SPLIT} AS split", f"{POST_TEXT} AS text"]

CTE_TEXTS = f"texts AS (SELECT {', '.join(POST_COLUMNS)} FROM documents)"
CTE_POSTS = (
    f"posts AS (SELECT id, {LABEL} AS label, split, text"
    f" FROM texts LEFT JOIN (SELECT doc_id AS id, quality, toxic FROM labels) USING (id))"
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, text) without the labels, for steps that do not need the join."""
    return documents(spark, sf_dir).selectExpr(*POST_COLUMNS)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "id")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, split, text); posts without a label row count as neutral.

    The side of the join is left to the optimizer, which broadcasts the labels only
    while their measured size allows it.
    """
    joined = post_texts(spark, sf_dir).join(labels(spark, sf_dir), "id", "left")
    return joined.selectExpr("id", f"{LABEL} AS label", "split", "text")


def bucketed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`posts`, from a table of texts that is bucketed by id, with a folder for
    each split: the join moves labels only, and readers of a split skip the others."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*POST_COLUMNS)
    table = read_table(spark, save_bucketed(texts, "posts", "id", by="split"))
    joined = table.join(labels(spark, sf_dir), "id", "left")
    return joined.selectExpr("id", f"{LABEL} AS label", "split", "text")


def with_label(spark: SparkSession, sf_dir: str, table: DataFrame) -> DataFrame:
    """``table`` (id, ...) with the class of each post."""
    joined = table.join(labels(spark, sf_dir), "id", "left")
    return joined.select(*table.columns, F.expr(f"{LABEL} AS label"))


def post_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, split) read without the texts."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*POST_COLUMNS[:2])
    return ids.join(labels(spark, sf_dir), "id", "left").selectExpr(
        "id", f"{LABEL} AS label", "split"
    )


def with_scores(table: DataFrame) -> DataFrame:
    """Append the array of the three scores."""
    return table.selectExpr("*", f"array({', '.join(SCORES)}) AS scores")
