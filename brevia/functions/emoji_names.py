"""Names of emoji, derived by rule from the Unicode character names.

The spoken name of most emoji is its Unicode character name in lower case with
underscores.  ``_RULES`` covers the families that differ in a regular way and
``_SHORT_NAMES`` the rest, so no large table is kept.  Sequences (professions,
gendered roles, families, couples, hair styles) are composed from their parts.

A table that follows the public Unicode emoji file exactly, including symbols
newer than the running Python, can be had with :func:`names_from_unicode_file`.

Everything here is driver-side set-up of about 1,700 fixed names; it does not
grow with the data.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import regex

ZWJ = "\u200d"
VS16 = "\ufe0f"
TONES = "\U0001f3fb\U0001f3fc\U0001f3fd\U0001f3fe\U0001f3ff"
FEMALE, MALE = "♀", "♂"
REGIONAL_A = 0x1F1E6

# Regular differences between character name and spoken name.
_RULES = [
    (r"^clock_face_(\w+)_oclock$", "\\1_o’clock"),
    (r"^clock_face_(\w+-thirty)$", r"\1"),
    (r"_moon_with_face$", "_moon_face"),
    (r"^large_(\w+)_(circle|square)$", r"\1_\2"),
    (r"^medium_(black|white)_circle$", r"\1_circle"),
    (r"_medium_small_square$", "_medium-small_square"),
    (r"^(wolf|fox|lion|unicorn|zebra|giraffe|hamster|bear|panda|frog|robot)_face$", r"\1"),
    (r"_cat_face(?=_|$)", "_cat"),
    (r"^cat_face_with", "cat_with"),
    (r"heart-shaped_eyes", "heart-eyes"),
    (r"^(japanese)_(ogre|goblin)$", r"\2"),
    (r"^japanese_", "Japanese_"),
    (r"^tokyo_", "Tokyo_"),
    (r"^christmas_", "Christmas_"),
    (r"^european_", ""),
    (r"_japan$", "_Japan"),
    (r"^statue_of_liberty$", "Statue_of_Liberty"),
    (r"_of_david$", "_of_David"),
    (r"^earth_globe_(\w+)-(\w+)$", lambda m: f"globe_showing_{m[1].title()}-{m[2].title()}"),
    (r"^earth_globe_(\w+)$", lambda m: f"globe_showing_{m[1].title()}"),
    (r"^(aries|taurus|gemini|cancer|leo|virgo|libra|sagittarius|capricorn|aquarius|pisces|ophiuchus)$",
     lambda m: m[1].title()),
    (r"^(wo)?mans_(clothes|shoe|sandal|hat)$", "\\1man’s_\\2"),
    (r"^(wo)?mens_symbol$", "\\1men’s_room"),
    (r"^white_(left|right|up|down)_pointing_backhand_index$", r"backhand_index_pointing_\1"),
    (r"^banknote_with_(\w+)_sign$", r"\1_banknote"),
    (r"^chart_with_upwards_trend", "chart_increasing"),
    (r"^chart_with_downwards_trend", "chart_decreasing"),
    (r"_and_yen_sign$", "_with_yen"),
    (r"^(left|right)-pointing_magnifying_glass$", r"magnifying_glass_tilted_\1"),
    (r"_with_cancellation_stroke$", "_with_slash"),
    (r"^squared_(cl|cool|free|id|new|ng|ok|sos|vs)$", lambda m: f"{m[1].upper()}_button"),
    (r"^negative_squared_(?:latin_capital_letter_)?(a|b|ab|o)$",
     lambda m: f"{m[1].upper()}_button_(blood_type)"),
    (r"^negative_squared_latin_capital_letter_p$", "P_button"),
    (r"^(back|end|soon|top)_with_\w+_arrow_above$", lambda m: f"{m[1].upper()}_arrow"),
    (r"^(up|down)wards_black_arrow$", r"\1_arrow"),
    (r"^black_(left|right)wards_arrow$", r"\1_arrow"),
    (r"^north_(ea|we)st_arrow$", lambda m: "up-right_arrow" if m[1] == "ea" else "up-left_arrow"),
    (r"^south_(ea|we)st_arrow$", lambda m: "down-right_arrow" if m[1] == "ea" else "down-left_arrow"),
    (r"^(up_down|left_right)_arrow$", lambda m: m[1].replace("_", "-") + "_arrow"),
    (r"^(up|down)-pointing_small_red_triangle$", r"\1wards_button"),
    (r"^(up|down)-pointing_red_triangle$", r"red_triangle_pointed_\1"),
    (r"^black_(up|down)-pointing_double_triangle$", r"fast_\1_button"),
    (r"^input_symbol_for_(?:latin_)?(letters)$", r"input_latin_\1"),
    (r"^input_symbol_for_(numbers|symbols)$", r"input_\1"),
    (r"^(black|white)_(question|exclamation)_mark_ornament$", r"\1_\2_mark"),
    (r"^heavy_(plus|minus)_sign$", r"\1"),
    (r"^black_(spade|heart|diamond|club)_suit$", r"\1_suit"),
    (r"^black_(telephone|scissors|chess_pawn)$", r"\1"),
    (r"^(eight|six)_(spoked|pointed)_", r"\1-\2_"),
    (r"^lower_left_(\w+)$", r"\1"),
    (r"^waving_(black|white)_flag$", r"\1_flag"),
    (r"^(derelict_)?house_building$", r"\1house"),
    (r"^(two_)?(\w*men)_holding_hands$", r"\2_holding_hands"),
    (r"^emoji_component_(\w+)$", r"\1"),
    (r"^(spiral)_(note|calendar)_pad$", lambda m: f"spiral_{'notepad' if m[2] == 'note' else 'calendar'}"),
    (r"^(standing|kneeling)_person$", r"person_\1"),
    (r"^(kissing|pouting)_cat_with_closed_eyes$", r"\1_cat"),
    (r"^smiling_cat_with_open_mouth$", "grinning_cat"),
    (r"^(?:slice|ball|bar|spool)_of_", ""),
    (r"_(?:and_(?:hoop|fish|ski_boot)|bottle_and_cup|(?:racquet|stick)_and_\w+)$", ""),
    (r"^(?:cheering|electric|izakaya|extraterrestrial|public_address|dark|playing_card|school)_", ""),
    (r"^red_gift_", "red_"),
    (r"^sunset_over_buildings$", "sunset"),
    (r"^(running_shirt|triangular_flag|speaking_head|menorah|drum|dove|eight-pointed|bullet_train)_"
     r"(?:with_sash|on_post|in_silhouette|with_nine_branches|with_drumsticks|of_peace)$", r"\1"),
    (r"_shape_with_a_dot_inside$", "_with_a_dot"),
    (r"^older_(man|woman)$", r"old_\1"),
    (r"^silhouette_of_", "map_of_"),
    (r"^(snow)_capped_", r"\1-capped_"),
    (r"^(high|low)_brightness_symbol$", lambda m: "bright_button" if m[1] == "high" else "dim_button"),
    (r"^(un)?(lock)_with_(?:ink_)?(pen|key)$", r"\2ed_with_\3"),
    (r"^closed_lock_with_key$", "locked_with_key"),
    (r"^open_lock$", "unlocked"),
    (r"^lock$", "locked"),
    (r"^wrapped_present$", "wrapped_gift"),
    (r"^person_(?:with_)?(pouting|bowing|blond_hair)(?:_face|_deeply)?$", r"person_\1"),
    (r"^face_with_(no_good|ok)_gesture$",
     lambda m: "person_gesturing_" + ("NO" if m[1] == "no_good" else "OK")),
    (r"^(first|second|third)_place_medal$",
     lambda m: {"first": "1st", "second": "2nd", "third": "3rd"}[m[1]] + "_place_medal"),
    (r"^face_with_stuck-out_tongue$", "face_with_tongue"),
    (r"^face_with_stuck-out_tongue_and_(winking|tightly-closed)_eyes?$",
     lambda m: ("winking" if m[1] == "winking" else "squinting") + "_face_with_tongue"),
    (r"^emoji_modifier_fitzpatrick_type-([\d-]+)$",
     lambda m: {"1-2": "light", "3": "medium-light", "4": "medium", "5": "medium-dark", "6": "dark"}[m[1]]
     + "_skin_tone"),
    (r"^(surf|swimm|golf|fenc)er$", r"person_\1ing"),
    (r"^(heavy)_(check_mark|exclamation_mark|division)(?:_symbol|_sign)?$",
     lambda m: {"check_mark": "check_mark", "exclamation_mark": "red_exclamation_mark"}.get(m[2], "divide")),
    (r"^white_(smiling|frowning)_face$", r"\1_face"),
    (r"^black_question_mark$", "red_question_mark"),
    (r"^leftwards_black_arrow$", "left_arrow"),
    (r"^optical_disc$", "optical_disk"),
    (r"^(musical|multiple_musical)_notes$", "musical_notes"),
    (r"^(personal_)computer$", "laptop"),
    (r"^speaker_with_(one|three)_sound_waves?$",
     lambda m: f"speaker_{'medium' if m[1] == 'one' else 'high'}_volume"),
    (r"^speaker$", "speaker_low_volume"),
    (r"^input_symbol_for_latin_(capital|small)_letters$",
     lambda m: f"input_latin_{'upper' if m[1] == 'capital' else 'lower'}case"),
    (r"^(salt)_shaker$|^(mate)_drink$|^(ice)_cube$", lambda m: m[1] or m[2] or m[3]),
    (r"^(\w+)_with_swirl_design$", r"\1_with_swirl"),
    (r"^(steam)_(locomotive)$", r"\2"),
    (r"^(racing)_(motorcycle)$", r"\2"),
    (r"^curry_and_rice$", "curry_rice"),
    (r"^man_and_woman_", "woman_and_man_"),
    (r"^(older)_adult$", r"\1_person"),
    (r"^adult$", "person"),
    (r"^bearded_person$", "person_beard"),
    (r"^clockwise_rightwards_and_leftwards_open_circle_arrows$", "repeat_button"),
    (r"^black_(left|right)-pointing_triangle$",
     lambda m: "reverse_button" if m[1] == "left" else "play_button"),
    (r"^eject_symbol$", "eject_button"),
    (r"^black_(square|circle)_for_(stop|record)$", r"\2_button"),
    (r"^(overheated|freezing)_face$", lambda m: "hot_face" if m[1] == "overheated" else "cold_face"),
    (r"^(jigsaw)_(puzzle_piece)$", r"\2"),
    (r"^(eye)(glasses)$", r"\2"),
    (r"^(baby|anger|wheelchair)_symbol$", r"\1~symbol"),
    (r"^heavy_equals_sign$", "heavy_equals~sign"),
    (r"(?<!heavy_dollar)(?<!dollar)(?<!peace)(?<!om)(?<!recycling)(?<!trident)(?<!no)(?<!victory)(?<!of)"
     r"(?<!horns)(?<!female)(?<!male)(?<!stop)(?<!octagonal)_(?:symbol|sign)$", ""),
    (r"~", "_"),
]

# Spoken names that follow no rule (character, name), in code point order.
_SHORT_NAMES = """
ℹ information  ↩ right_arrow_curving_left  ↪ left_arrow_curving_right  ⌛ hourglass_done
⏩ fast-forward_button  ⏪ fast_reverse_button  ⏭ next_track_button  ⏮ last_track_button
⏯ play_or_pause_button  ⏳ hourglass_not_done  ⏸ pause_button  Ⓜ circled_M  ☀ sun
☑ check_box_with_check  ☝ index_pointing_up  ♏ Scorpio  ♻ recycling_symbol  ♾ infinity
⚕ medical_symbol  ⚖ balance_scale  ⚧ transgender_symbol  ⛈ cloud_with_lightning_and_rain
⛑ rescue_worker’s_helmet  ⛹ person_bouncing_ball  ✅ check_mark_button  ✖ multiply
✴ eight-pointed_star  ❎ cross_mark_button  ❣ heart_exclamation  ❤ red_heart  ⤴ right_arrow_curving_up
⤵ right_arrow_curving_down  ⭐ star  ⭕ hollow_red_circle  ㊗ Japanese_“congratulations”_button
㊙ Japanese_“secret”_button  🀄 mahjong_red_dragon  🃏 joker  🆙 UP!_button  🈁 Japanese_“here”_button
🈂 Japanese_“service_charge”_button  🈚 Japanese_“free_of_charge”_button  🈯 Japanese_“reserved”_button
🈲 Japanese_“prohibited”_button  🈳 Japanese_“vacancy”_button  🈴 Japanese_“passing_grade”_button
🈵 Japanese_“no_vacancy”_button  🈶 Japanese_“not_free_of_charge”_button
🈷 Japanese_“monthly_amount”_button  🈸 Japanese_“application”_button  🈹 Japanese_“discount”_button
🈺 Japanese_“open_for_business”_button  🉐 Japanese_“bargain”_button  🉑 Japanese_“acceptable”_button
🌤 sun_behind_small_cloud  🌥 sun_behind_large_cloud  🌦 sun_behind_rain_cloud  🌪 tornado  🌬 wind_face
🌽 ear_of_corn  🌾 sheaf_of_rice  🍆 eggplant  🎅 Santa_Claus  🎇 sparkler  🎒 backpack  🎯 bullseye
🎱 pool_8_ball  🎿 skis  🏃 person_running  🏋 person_lifting_weights  🏏 cricket_game  🏓 ping_pong
🏘 houses  🏧 ATM_sign  🏮 red_paper_lantern  🐑 ewe  🐪 camel  🐫 two-hump_camel  👊 oncoming_fist
👌 OK_hand  👝 clutch_bag  👟 running_shoe  👢 woman’s_boot  👯 people_with_bunny_ears  👰 person_with_veil
👲 person_with_skullcap  👳 person_wearing_turban  👿 angry_face_with_horns  💁 person_tipping_hand
💂 guard  💃 woman_dancing  💆 person_getting_massage  💇 person_getting_haircut  💤 ZZZ  💦 sweat_droplets
💨 dashing_away  💽 computer_disk  📩 envelope_with_arrow  📲 mobile_phone_with_arrow  📶 antenna_bars
🔀 shuffle_tracks_button  🔂 repeat_single_button  🔃 clockwise_vertical_arrows
🔄 counterclockwise_arrows_button  🔇 muted_speaker  🔌 electric_plug  🔛 ON!_arrow  🔟 keycap_10
🔦 flashlight  🔪 kitchen_knife  🔫 water_pistol  🔯 dotted_six-pointed_star  🕉 om
🕴 person_in_suit_levitating  🕵 detective  🖊 pen  🖐 hand_with_fingers_splayed  🖕 middle_finger
🖖 vulcan_salute  🖱 computer_mouse  🖼 framed_picture  🗜 clamp  🗡 dagger  🗿 moai
😁 beaming_face_with_smiling_eyes  😃 grinning_face_with_big_eyes  😄 grinning_face_with_smiling_eyes
😅 grinning_face_with_sweat  😆 grinning_squinting_face  😋 face_savoring_food
😓 downcast_face_with_sweat  😘 face_blowing_a_kiss  😡 enraged_face  😤 face_with_steam_from_nose
😥 sad_but_relieved_face  😰 anxious_face_with_sweat  😵 face_with_crossed-out_eyes
🙋 person_raising_hand  🙌 raising_hands  🙏 folded_hands  🚅 bullet_train  🚙 sport_utility_vehicle
🚣 person_rowing_boat  🚨 police_car_light  🚫 prohibited  🚬 cigarette  🚮 litter_in_bin_sign
🚯 no_littering  🚴 person_biking  🚵 person_mountain_biking  🚶 person_walking  🛀 person_taking_bath
🛌 person_in_bed  🛑 stop_sign  🛒 shopping_cart  🛬 airplane_arrival  🛴 kick_scooter
🤗 smiling_face_with_open_hands  🤞 crossed_fingers  🤟 love-you_gesture  🤠 cowboy_hat_face
🤦 person_facepalming  🤨 face_with_raised_eyebrow  🤩 star-struck  🤪 zany_face  🤫 shushing_face
🤬 face_with_symbols_on_mouth  🤭 face_with_hand_over_mouth  🤮 face_vomiting  🤯 exploding_head
🤵 person_in_tuxedo  🤶 Mrs._Claus  🤷 person_shrugging  🤸 person_cartwheeling  🤹 person_juggling
🤼 people_wrestling  🤽 person_playing_water_polo  🤾 person_playing_handball  🥝 kiwi_fruit
🥰 smiling_face_with_hearts  🥳 partying_face  🥴 woozy_face  🥺 pleading_face  🦖 T-Rex  🦯 white_cane
🧕 woman_with_headscarf  🧬 dna  🪅 piñata
"""

# Second part of a person sequence and the role it stands for.
_ROLES = {
    "⚕": "health_worker", "⚖": "judge", "✈": "pilot", "🌾": "farmer", "🍳": "cook",
    "🎓": "student", "🎤": "singer", "🎨": "artist", "🏫": "teacher", "🏭": "factory_worker",
    "💻": "technologist", "💼": "office_worker", "🔧": "mechanic", "🔬": "scientist",
    "🚀": "astronaut", "🚒": "firefighter",
}
_TRAITS = {
    "🍼": "feeding_baby", "🦯": "with_white_cane", "🦼": "in_motorized_wheelchair",
    "🦽": "in_manual_wheelchair", "🦰": "red_hair", "🦱": "curly_hair", "🦲": "bald",
    "🦳": "white_hair",
}
_TURNS_RIGHT = ("walking", "running", "kneeling", "with_white_cane",
                "in_motorized_wheelchair", "in_manual_wheelchair")
# Person emoji outside the ``person_*`` names that have gendered forms.
_GENDERED = (
    "construction_worker", "deaf_person", "detective", "elf", "fairy", "genie", "guard", "mage",
    "merperson", "people_with_bunny_ears", "people_wrestling", "police_officer", "superhero",
    "supervillain", "vampire", "zombie",
)
_UNGENDERED = ("person_in_bed", "person_taking_bath", "person_in_suit_levitating",
               "person_fencing", "person_with_skullcap", "person_with_crown")
# Remaining joined sequences, parts separated by "+".
_JOINED = {
    "⛓+💥": "broken_chain", "❤+🔥": "heart_on_fire", "❤+🩹": "mending_heart",
    "🍄+🟫": "brown_mushroom", "🍋+🟩": "lime", "🏳+⚧": "transgender_flag",
    "🏳+🌈": "rainbow_flag", "🏴+☠": "pirate_flag", "🐈+⬛": "black_cat", "🐕+🦺": "service_dog",
    "🐦+⬛": "black_bird", "🐦+🔥": "phoenix", "🐻+❄": "polar_bear", "👁+🗨": "eye_in_speech_bubble",
    "😮+💨": "face_exhaling", "😵+💫": "face_with_spiral_eyes", "😶+🌫": "face_in_clouds",
    "🙂+↔": "head_shaking_horizontally", "🙂+↕": "head_shaking_vertically", "🧑+🎄": "Mx_Claus",
    "🧑+🤝+🧑": "people_holding_hands", "👩+🤝+👨": "woman_and_man_holding_hands",
    "👨+🤝+👨": "men_holding_hands", "👩+🤝+👩": "women_holding_hands", "🫱+🫲": "handshake",
    "🧑+🧑+🧒": "family_adult_adult_child", "🧑+🧑+🧒+🧒": "family_adult_adult_child_child",
    "🧑+🧒": "family_adult_child", "🧑+🧒+🧒": "family_adult_child_child",
}
# Flags outside the ISO list and flags of the parts of the United Kingdom.
_EXTRA_REGIONS = ("AC", "CP", "DG", "EA", "EU", "IC", "TA", "UN", "XK")
_RENAMED_REGIONS = {"TR": "Türkiye"}
_TAG_FLAGS = {"gbeng": "England", "gbsct": "Scotland", "gbwls": "Wales"}


@dataclass(frozen=True, eq=False)
class EmojiNames:
    """Spoken names: of one code point, of joined sequences (without variation
    selectors and skin tones) and of two-letter regions; plus the code points
    that take a skin tone."""

    single: dict[str, str]
    joined: dict[str, str]
    regions: dict[str, str] = field(default_factory=dict)
    tonable: frozenset[str] = frozenset()


def _single_names() -> dict[str, str]:
    names = {}
    for char in regex.findall(r"\p{Emoji}", "".join(map(chr, range(0xA0, 0x1FB00)))):
        name = unicodedata.name(char, "").lower().replace(" ", "_")
        for pattern, form in _RULES:
            name = re.sub(pattern, form, name)
        if name and not name.startswith("regional_indicator"):
            names[char] = name
    char = ""
    for entry in _SHORT_NAMES.split():
        if len(entry) == 1:
            char = entry
        else:
            names[char] = entry
    return names


def _gendered_name(name: str, woman: bool) -> str:
    if name == "merperson":
        return "mermaid" if woman else "merman"
    if name == "deaf_person":
        return "deaf_woman" if woman else "deaf_man"
    word, plural = ("woman", "women") if woman else ("man", "men")
    name, swapped = re.subn(r"^person(?=_)", word, name)
    name, swapped_many = re.subn(r"^people(?=_)", plural, name)
    return name if swapped or swapped_many else f"{word}_{name}"


def _joined_names(single: dict[str, str]) -> dict[str, str]:
    people = {"🧑": "", "👨": "man", "👩": "woman"}
    names = {parts.replace("+", ZWJ): name for parts, name in _JOINED.items()}
    for person, word in people.items():
        for part, role in _ROLES.items():
            names[person + ZWJ + part] = f"{word}_{role}" if word else role
        for part, trait in _TRAITS.items():
            names[person + ZWJ + part] = f"{word or 'person'}_{trait}"
    for char, name in single.items():
        if name in _GENDERED or (name.startswith("person_") and name not in _UNGENDERED):
            names[char + ZWJ + FEMALE] = _gendered_name(name, woman=True)
            names[char + ZWJ + MALE] = _gendered_name(name, woman=False)
    for base, name in list(single.items()) + list(names.items()):
        if name.endswith(_TURNS_RIGHT) and name.startswith(("person_", "man_", "woman_")):
            names[base + ZWJ + "➡"] = f"{name}_facing_right"
    adults = [("👨",), ("👩",), ("👨", "👩"), ("👨", "👨"), ("👩", "👩")]
    children = [("👦",), ("👧",), ("👧", "👦"), ("👦", "👦"), ("👧", "👧")]
    for family in (a + c for a in adults for c in children):
        names[ZWJ.join(family)] = "_".join(["family", *(single[p] for p in family)])
    for first, second in (("👩", "👨"), ("👨", "👨"), ("👩", "👩"), ("🧑", "🧑")):
        pair = f"{single[first]}_{single[second]}"
        names[ZWJ.join((first, "❤", second))] = f"couple_with_heart_{pair}"
        names[ZWJ.join((first, "❤", "💋", second))] = f"kiss_{pair}"
    for region, name in _TAG_FLAGS.items():
        names["🏴" + "".join(chr(0xE0000 + ord(c)) for c in region) + "\U000e007f"] = name
    return names


def region_names(spark) -> dict[str, str]:
    """English names of ISO regions as the JVM's locale data gives them."""
    locale = spark.sparkContext._jvm.java.util.Locale
    codes = [*locale.getISOCountries(), *_EXTRA_REGIONS]
    shown = ((code, locale("", code).getDisplayCountry(locale.ENGLISH)) for code in codes)
    named = {code: name.replace(" ", "_") for code, name in shown if name != code}
    return named | _RENAMED_REGIONS


@lru_cache(maxsize=1)
def _rule_names() -> EmojiNames:
    single = _single_names()
    tonable = frozenset(regex.findall(r"\p{Emoji_Modifier_Base}", "".join(single)))
    return EmojiNames(single, _joined_names(single), {}, tonable)


@lru_cache(maxsize=1)
def default_names(spark) -> EmojiNames:
    names = _rule_names()
    return EmojiNames(names.single, names.joined, region_names(spark), names.tonable)


def names_from_unicode_file(spark, path: str) -> EmojiNames:
    """Names from the public Unicode file ``emoji-test.txt`` (about 5,000 lines)."""
    from pyspark.sql import functions as F

    line = r"^([0-9A-F ]+?)\s*;\s*\S+\s*#\s*\S+\s+E[\d.]+\s+(.*)$"
    listed = (
        spark.read.text(path)
        .filter(F.col("value").rlike(line))
        .select(F.regexp_extract("value", line, 1), F.regexp_extract("value", line, 2))
        .collect()
    )
    single, joined, regions, tonable = {}, {}, {}, set()
    for points, shown in listed:
        chars = "".join(chr(int(p, 16)) for p in points.split() if chr(int(p, 16)) != VS16)
        bare = chars.translate({ord(t): None for t in TONES})
        name = re.sub(r"^flag: ", "", shown)
        name = re.sub(r"[:,]", "", name).replace(" ", "_")
        if bare and bare != chars:
            tonable.update(a for a, b in zip(chars, chars[1:]) if b in TONES)
            name = re.sub(r"_(?:medium-)?(?:light|medium|dark)_skin_tone", "", name)
        if "\u20e3" in chars:
            continue
        if len(chars) == 1:
            single[chars] = name
        elif shown.startswith("flag: ") and all(0x1F1E6 <= ord(c) <= 0x1F1FF for c in chars):
            regions["".join(chr(ord(c) - REGIONAL_A + 65) for c in chars)] = name
        elif len(bare) > 1:
            joined.setdefault(bare, name)
    return EmojiNames(single, joined, regions, frozenset(tonable))
