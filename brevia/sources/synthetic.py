"""Synthetic posts for throughput measurements.

Every draw of a row comes from one SHA-256 digest of its id and the seed, so the
text of an id never depends on partitioning, retries or lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Base texts, additions and the odds of each addition.
BASE_TEXTS = [
    "Just had the best coffee ever! ☕ #MorningVibes",
    "@john check this out https://example.com/article",
    "Can't believe the news today 😢 #Sad",
    "Amazing game last night! 🏀 @Lakers vs @Celtics",
    "Working from home again... #WFH #RemoteWork",
    "This new feature is 🔥🔥🔥 https://product.io/launch",
    "@alice @bob did you see the announcement? 👀",
    "Monday blues hitting hard 😩 #Monday",
    "Best day ever! 🎉🎊 Thanks @everyone for the support",
    "Not sure about this decision... 🤔 https://news.com/story",
]
EMOJIS = ["😊", "😢", "🔥", "👀", "🎉", "😩", "🤔", "💯", "❤️", "👍", "😂", "🙏"]
HASHTAGS = ["#AI", "#Python", "#DataScience", "#ML", "#NLP", "#Tech", "#News", "#Life"]
URLS = ["https://example.com", "https://site.io/page", "http://link.co/x", "https://a.b/c"]
USERS = ["user1", "user2", "user3"]
EMOJI_ODDS, HASHTAG_ODDS, URL_ODDS, USER_ODDS = 0.3, 0.2, 0.15, 0.1
SEED = 42

# Each draw reads seven hexadecimal digits of the digest.
DRAW_DIGITS = 7
DRAW_RANGE = 16**DRAW_DIGITS


def synthetic_text(id_col: Column, seed: int = SEED) -> Column:
    digest = F.sha2(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))), 256)

    def draw(k: int) -> Column:
        digits = F.substring(digest, 1 + k * DRAW_DIGITS, DRAW_DIGITS)
        return F.conv(digits, 16, 10).cast("long")

    def pick(k: int, pool: list[str]) -> Column:
        at = (draw(k) % len(pool)).cast("int")
        return F.get(F.array(*map(F.lit, pool)), at)

    def maybe(k: int, odds: float, part: Column) -> Column:
        return F.when(draw(k) < round(odds * DRAW_RANGE), part).otherwise(F.lit(""))

    return F.concat(
        maybe(7, USER_ODDS, F.concat(F.lit("@"), pick(8, USERS), F.lit(" "))),
        pick(0, BASE_TEXTS),
        maybe(1, EMOJI_ODDS, F.concat(F.lit(" "), pick(2, EMOJIS))),
        maybe(3, HASHTAG_ODDS, F.concat(F.lit(" "), pick(4, HASHTAGS))),
        maybe(5, URL_ODDS, F.concat(F.lit(" "), pick(6, URLS))),
    )


def synthetic_posts(ids: DataFrame, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """One synthetic post for each id of a table."""
    return ids.select(F.col(id_col).alias("id"), synthetic_text(F.col(id_col), seed).alias("text"))


def generate_posts(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """``n`` synthetic posts."""
    return synthetic_posts(spark.range(n), seed=seed)
