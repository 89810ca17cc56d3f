"""Fixed values of the text rules: names, tokens and Java regular expressions."""

# Class names by label id, replacement tokens, added column.
LABEL_NAMES = ("negative", "neutral", "positive")
URL_TOKEN = "[URL]"
USER_TOKEN = "@user"
CLEAN_SUFFIX = "_cleaned"

# What Python counts as white space and as a word character.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WORD_CLASS = r"\p{L}\p{N}_"
# Java's Unicode white space lacks four control characters.  This form is used where
# many characters are tested: Java is slow on classes of many ranges.
VISIBLE_RUN = r"(?U:[^\s\x1c-\x1f]+)"

# Patterns of the cleaning rules.
URL = rf"https?://{VISIBLE_RUN}"
MENTION = rf"@[{WORD_CLASS}]+"
HASHTAG = rf"#([{WORD_CLASS}]+)"

# Patterns of the noise profile, on purpose other than the cleaning rules.
NOISE = {
    "mentions": r"@user",
    "urls": URL,
    "hashtags": rf"#{VISIBLE_RUN}",
    "retweets": rf"(?:^|[^{WORD_CLASS}])RT(?:$|[^{WORD_CLASS}])",
    "emojis": r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]",
}
# Text without this cannot match the pattern, and looking for it is cheaper.
NOISE_GATES = {"retweets": "RT", "emojis": r"[\x{1F1E0}-\x{1F6FF}]"}

# Tokens of our own vocabulary: runs of word characters, or one other visible character.
TOKEN = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}{SPACE_CLASS}]"
WORD = VISIBLE_RUN
