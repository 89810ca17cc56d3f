"""Emoji names: known ones, sequences, and text that only looks similar."""

import pytest

from brevia.functions.emoji import handle_emojis
from brevia.functions.emoji_names import default_names, names_from_unicode_file

KNOWN = {
    "☕": ":hot_beverage:", "😢": ":crying_face:", "🏀": ":basketball:", "🔥": ":fire:", "👀": ":eyes:",
    "😩": ":weary_face:", "🎉": ":party_popper:", "🎊": ":confetti_ball:", "🤔": ":thinking_face:",
    "💯": ":hundred_points:", "❤️": ":red_heart:", "❤": ":red_heart:", "👍": ":thumbs_up:",
    "😂": ":face_with_tears_of_joy:", "🙏": ":folded_hands:", "😍": ":smiling_face_with_heart-eyes:",
    "🔥🔥": ":fire::fire:", "a🔥b": "a:fire:b", "🕐": ":one_o’clock:", "🥇": ":1st_place_medal:",
    "🆗": ":OK_button:", "♈": ":Aries:", "©®™": ":copyright::registered::trade_mark:",
    "🇧🇷": ":Brazil:", "🇺🇸🇵🇹": ":United_States::Portugal:", "🏴󠁧󠁢󠁳󠁣󠁴󠁿": ":Scotland:",
    "1️⃣#️⃣*⃣": ":keycap_1::keycap_#::keycap_*:",
    "👍🏻": ":thumbs_up_light_skin_tone:", "👍🏿!": ":thumbs_up_dark_skin_tone:!",
    "👨‍👩‍👧": ":family_man_woman_girl:", "👩🏽‍💻": ":woman_technologist_medium_skin_tone:",
    "🤷‍♂️": ":man_shrugging:", "🤷🏼‍♂": ":man_shrugging_medium-light_skin_tone:",
    "🧔🏻‍♂️": ":man_light_skin_tone_beard:", "👨🏾‍🦰": ":man_medium-dark_skin_tone_red_hair:",
    "👩‍❤️‍💋‍👨": ":kiss_woman_man:", "🏳️‍🌈": ":rainbow_flag:", "❤️‍🔥": ":heart_on_fire:",
    "🧑🏻‍🤝‍🧑🏿": ":people_holding_hands_light_skin_tone_dark_skin_tone:",
}


@pytest.mark.parametrize("text,expected", KNOWN.items())
def test_known_emoji(one, text, expected):
    assert one(handle_emojis, text) == expected


@pytest.mark.parametrize("text", [
    "", "plain", "12 * 3 # 4", "日本語 カタカナ 한국어", "→ € ∑ ─", "é ‍ ️", "🇦", "naïve Ωß",
])
def test_other_text_stays(one, text):
    assert one(handle_emojis, text) == text


def test_null_stays_null(one):
    assert one(handle_emojis, None) is None


def test_unlisted_sequence_is_named_part_by_part(one):
    assert one(handle_emojis, "🔥‍😊") == ":fire:‍:smiling_face_with_smiling_eyes:"
    assert one(handle_emojis, "🔥🏽") == ":fire::medium_skin_tone:"


def test_every_single_name_is_used_whole(spark):
    from pyspark.sql import functions as F

    names = default_names(spark)
    assert len(names.single) > 1300 and len(names.joined) > 200 and len(names.regions) > 240
    rows = [(c, f":{n}:") for c, n in names.single.items()]
    rows += [(c, f":{n}:") for c, n in names.joined.items()]
    df = spark.createDataFrame(rows, "text string, expected string")
    wrong = df.withColumn("found", handle_emojis(F.col("text"))).filter("found <> expected")
    assert wrong.collect() == []


def test_names_can_come_from_the_unicode_file(spark, one, tmp_path):
    lines = [
        "# group: Smileys & Emotion", "",
        "1F525 ; fully-qualified # 🔥 E0.6 fire",
        "1FAE9 ; fully-qualified # 🫩 E16.0 face with bags under eyes",
        "1F44D ; fully-qualified # 👍 E0.6 thumbs up",
        "1F44D 1F3FB ; fully-qualified # 👍🏻 E1.0 thumbs up: light skin tone",
        "1F3FB ; component # 🏻 E1.0 light skin tone", "1F3FC ; component # 🏼 E1.0 medium-light skin tone",
        "1F3FD ; component # 🏽 E1.0 medium skin tone", "1F3FE ; component # 🏾 E1.0 medium-dark skin tone",
        "1F3FF ; component # 🏿 E1.0 dark skin tone",
        "2764 FE0F 200D 1F525 ; fully-qualified # ❤️‍🔥 E13.1 heart on fire",
        "1F1E7 1F1F7 ; fully-qualified # 🇧🇷 E2.0 flag: Brazil",
        "0031 FE0F 20E3 ; fully-qualified # 1️⃣ E0.6 keycap: 1",
    ]
    path = tmp_path / "emoji-test.txt"
    path.write_text("\n".join(lines), encoding="utf-8")
    names = names_from_unicode_file(spark, str(path))
    found = one(lambda t: handle_emojis(t, names), "🫩🔥👍🏿❤️‍🔥🇧🇷1️⃣😊")
    assert found == (
        ":face_with_bags_under_eyes::fire::thumbs_up_dark_skin_tone::heart_on_fire:"
        ":Brazil::keycap_1:😊"
    )
