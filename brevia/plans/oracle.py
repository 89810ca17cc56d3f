"""The registered queries as SQL for DuckDB, to check their results."""

from __future__ import annotations

from ..functions.patterns import (
    HASHTAG, LABEL_NAMES, MENTION, NOISE, SPACE_CLASS, TOKEN, URL, URL_TOKEN, USER_TOKEN,
    VISIBLE_RUN, WHITESPACE, WORD,
)
from ..operators.tokens import BOS, EOS, MAX_LENGTH, PAD, SPECIAL_TOKENS, UNK
from .derived import (
    CSV_LINE, CTE_POSTS, CTE_TEXTS, EMOJI_TEXT, LINE_IS_BROKEN, OTHER_EMOJI_NAMES,
    POST_EMOJI_NAMES, SCORES, SOME_TEXT,
    SOME_IDS,
)
from .queries import DIGITS, VOCABULARY_SIZE

TEXTS = f"WITH {CTE_TEXTS}"
POSTS = f"WITH {CTE_TEXTS}, {CTE_POSTS}"


def re2(pattern: str) -> str:
    """The pattern for RE2, whose classes have no Unicode white space."""
    return pattern.replace(VISIBLE_RUN, f"[^{SPACE_CLASS}]+")


def replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{re2(pattern)}', '{by}', 'g')"


def matches(pattern: str) -> str:
    return f"regexp_matches(text, '{re2(pattern)}')"


def count_of(text: str, pattern: str, kind: str = "BIGINT") -> str:
    return f"CAST(len(regexp_extract_all({text}, '{re2(pattern)}')) AS {kind})"


def named(text: str, names: dict[str, str]) -> str:
    """Nested replacements, longest emoji first (the tables are in that order)."""
    for emoji, name in names.items():
        text = f"replace({text}, '{emoji}', ':{name}:')"
    return text


def urls(text: str) -> str:
    return f"trim({replaced(text, URL, URL_TOKEN)}, '{WHITESPACE}')"


def markup(text: str) -> str:
    return replaced(replaced(urls(text), MENTION, USER_TOKEN), HASHTAG, r"\1")


def cleaned(text: str) -> str:
    return f"lower({named(markup(text), POST_EMOJI_NAMES)})"


def label_name(label: str = "label") -> str:
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(LABEL_NAMES))
    return f"CASE {label} {cases} END"


def on_text(expression: str, name: str = "text") -> str:
    return f"{TEXTS} SELECT id, {expression} AS {name} FROM texts"


# Posts with their predicted class.
SCORED = (
    f"{POSTS}, scored AS (SELECT *, [{', '.join(SCORES)}] AS scores FROM posts),"
    " predicted AS (SELECT *, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS pred"
    " FROM scored)"
)
FIRST_TEST = "(SELECT * FROM predicted WHERE split = 'test' ORDER BY id LIMIT 1000)"


def class_metrics(source: str) -> str:
    return (
        f"classes AS (SELECT label AS class FROM {source} UNION SELECT pred FROM {source}),"
        " tallies AS (SELECT class,"
        f" (SELECT count(*) FROM {source} WHERE label = class AND pred = class) AS tp,"
        f" (SELECT count(*) FROM {source} WHERE label = class) AS support,"
        f" (SELECT count(*) FROM {source} WHERE pred = class) AS predicted FROM classes),"
        " measured AS (SELECT class, tp, support,"
        " CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,"
        " CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,"
        " 2 * tp / (support + predicted) AS f FROM tallies)"
    )


def report(source: str) -> str:
    def row(name: str, p: str, r: str, f: str, support: str, tail: str) -> str:
        return (
            f"SELECT {name} AS class, round({p}, {DIGITS}) AS precision, round({r}, {DIGITS}) AS recall,"
            f" round({f}, {DIGITS}) AS f1_score, CAST({support} AS BIGINT) AS support"
            f" FROM measured{tail}"
        )

    def weighted(m: str) -> str:
        return f"sum({m} * support) / sum(support)"

    none = "CAST(NULL AS DOUBLE)"
    return " UNION ALL ".join([
        f"{SCORED}, {class_metrics(source)} " + row("CAST(class AS VARCHAR)", "p", "r", "f", "support", ""),
        row("'accuracy'", none, none, "sum(tp) / sum(support)", "sum(support)", ""),
        row("'macro avg'", "avg(p)", "avg(r)", "avg(f)", "sum(support)", ""),
        row("'weighted avg'", weighted("p"), weighted("r"), weighted("f"), "sum(support)", ""),
    ])


TOKEN_COUNT = count_of("text", TOKEN)
WORD_COUNT = count_of("text", WORD)
LENGTHS = (
    "lengths AS (SELECT split, 'chars' AS metric, length(text) AS value FROM texts"
    f" UNION ALL SELECT split, 'words', {WORD_COUNT} FROM texts)"
)


def histogram(source: str, by: str, bins: str) -> str:
    """Bins of ``source`` (by..., metric, value); ``bins`` may use lo, hi, iqr and n."""
    keys = f"{by}metric"
    return (
        f"ranges AS (SELECT {keys}, min(value) AS lo, max(value) AS hi,"
        " median(value) AS median, count(*) AS n,"
        " quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr"
        f" FROM {source} GROUP BY {keys}),"
        f" spans AS (SELECT {keys}, median, CAST({bins} AS BIGINT) AS bins,"
        " 2 * lo - CASE WHEN lo = hi THEN 1 ELSE 0 END AS lo2,"
        " 2 * hi + CASE WHEN lo = hi THEN 1 ELSE 0 END AS hi2 FROM ranges),"
        f" placed AS (SELECT {keys}, least(((2 * value - lo2) * bins) // (hi2 - lo2), bins - 1) AS bin"
        f" FROM {source} JOIN spans USING ({keys})),"
        f" filled AS (SELECT {keys}, bin, count(*) AS n_rows FROM placed GROUP BY {keys}, bin),"
        " slots AS (SELECT *, unnest(range(bins)) AS bin FROM spans)"
        f" SELECT {keys}, bin, lo2 / 2 + bin * ((hi2 - lo2) / 2 / bins) AS bin_start,"
        " lo2 / 2 + (bin + 1) * ((hi2 - lo2) / 2 / bins) AS bin_end,"
        " CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, CAST(median AS DOUBLE) AS median"
        f" FROM slots LEFT JOIN filled USING ({keys}, bin)"
    )


AUTO_BINS = (
    "CASE WHEN hi > lo THEN ceil((hi - lo) / greatest(CASE WHEN iqr > 0"
    " THEN least(2 * iqr / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))"
    " ELSE (hi - lo) / (log2(n) + 1) END, 1.0)) ELSE 1 END"
)


def noise_profile() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS pattern, count(*) FILTER ({matches(pattern)}) AS occurrences,"
        f" count(*) FILTER ({matches(pattern)}) / count(*) * 100 AS pct"
        " FROM texts WHERE split = 'train'"
        for name, pattern in NOISE.items()
    )
    return f"{TEXTS} {rows}"


VOCABULARY = (
    f"words AS (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token"
    " FROM texts WHERE split = 'train'),"
    " ranked AS (SELECT token, count(*) AS n,"
    " row_number() OVER (ORDER BY count(*) DESC, token) AS place FROM words GROUP BY token),"
    f" vocabulary AS (SELECT token, n, CAST(place + {len(SPECIAL_TOKENS) - 1} AS INTEGER) AS token_id"
    f" FROM ranked WHERE place <= {VOCABULARY_SIZE})"
)


def encoded(max_length: int) -> str:
    room = max_length - 2
    return (
        f"{POSTS}, {VOCABULARY},"
        f" cut AS (SELECT id, label, split, list_slice(regexp_extract_all(text, '{TOKEN}'), 1, {room})"
        " AS toks FROM posts),"
        " placed AS (SELECT id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM cut),"
        f" ids AS (SELECT id, string_agg(' ' || coalesce(token_id, {UNK}), '' ORDER BY pos) AS body,"
        " count(*) AS n FROM placed LEFT JOIN vocabulary USING (token) GROUP BY id)"
        f" SELECT id, label, split, '{BOS}' || coalesce(body, '') || ' {EOS}'"
        f" || repeat(' {PAD}', {room} - coalesce(n, 0)) AS input_ids,"
        f" '1' || repeat(' 1', coalesce(n, 0) + 1) || repeat(' 0', {room} - coalesce(n, 0))"
        " AS attention_mask FROM cut LEFT JOIN ids USING (id)"
    )


def sample(n: int) -> str:
    return (
        f"{POSTS}, ranked AS (SELECT id, label, text, CAST(row_number() OVER (PARTITION BY label"
        " ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id) AS INTEGER) AS sample_rank"
        " FROM posts WHERE split = 'train')"
        f" SELECT id, {label_name()} AS label_name, sample_rank, CASE WHEN length(text) > 150"
        f" THEN substring(text, 1, 150) || '...' ELSE text END AS text FROM ranked WHERE sample_rank <= {n}"
    )


NUMBERED = (
    f"{POSTS}, numbered AS (SELECT row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0"
    " WHEN 'validation' THEN 1 ELSE 2 END, id) - 1 AS row_index, * FROM posts)"
)
OUTPUTS = (
    f"{TEXTS}, outputs AS (SELECT {SOME_IDS} AS id, {cleaned('text')} AS l,"
    f" lower({markup('text')}) AS r FROM texts), balance AS (SELECT id, v, sum(a) AS n_left,"
    " sum(b) AS n_right FROM (SELECT id, l AS v, 1 AS a, 0 AS b FROM outputs UNION ALL"
    " SELECT id, r, 0, 1 FROM outputs) GROUP BY id, v), keys AS (SELECT id,"
    " min(CASE WHEN n_left > n_right THEN substring(v, 1, 80) || '...' END) AS left_text,"
    " min(CASE WHEN n_right > n_left THEN substring(v, 1, 80) || '...' END) AS right_text"
    " FROM balance WHERE n_left <> n_right GROUP BY id)"
)

BY_POSITION = OUTPUTS.replace(f"{SOME_IDS} AS id", "row_number() OVER (ORDER BY id) - 1 AS id")

ORACLE: dict[str, str] = {
    "load_splits": f"{POSTS} SELECT id, label, split, text FROM posts",
    "csv_round_trip": f"{POSTS} SELECT id, label, text, {label_name()} AS label_name FROM posts",
    "union_splits": f"{NUMBERED} SELECT id, label, text, split, row_index FROM numbered",
    "head_in_file_order": (
        f"{NUMBERED} SELECT row_index, id, label, split, text FROM numbered WHERE row_index < 5"
    ),
    "csv_broken_rows": (
        f"WITH lines AS (SELECT *, {CSV_LINE} AS line, {LINE_IS_BROKEN} AS broken FROM documents),"
        " counts AS (SELECT count(*) FILTER (NOT broken) AS n_good, count(*) FILTER (broken) AS n_broken"
        " FROM lines), rows AS (SELECT doc_id AS id, n_chars, lang, coalesce(text, '') AS text,"
        " CAST(NULL AS VARCHAR) AS broken_record FROM lines WHERE NOT broken UNION ALL"
        " SELECT NULL, NULL, NULL, NULL, line FROM lines WHERE broken)"
        " SELECT rows.*, n_good, n_broken FROM rows, counts"
    ),
    "split_filter": f"{POSTS} SELECT id, label, split, text FROM posts WHERE split = 'train'",
    "label_names": f"{POSTS} SELECT id, label, split, {label_name()} AS label_name FROM posts",
    "clean_text": on_text(cleaned("text"), "text_cleaned"),
    "clean_passthrough": (
        f"SELECT *, lower({markup('text')}) AS text_cleaned FROM documents"
    ),
    "clean_nulls": (
        f"WITH given AS (SELECT doc_id AS id, coalesce({SOME_TEXT}, '') AS body FROM documents)"
        f" SELECT id, lower({markup('body')}) AS body_cleaned FROM given"
    ),
    "clean_csv": (
        f"WITH rows AS (SELECT doc_id, text AS body, {SOME_TEXT} AS some_text, lang, n_chars, quality"
        " FROM documents LEFT JOIN labels USING (doc_id)),"
        " known AS (SELECT *, coalesce(body, '') AS given FROM rows)"
        " SELECT CAST(doc_id AS INTEGER) AS doc_id, body, some_text, lang,"
        " CAST(n_chars AS INTEGER) AS n_chars, quality,"
        f" lower({markup('given')}) AS body_cleaned FROM known"
    ),
    "clean_stream": on_text(cleaned("text"), "text_cleaned"),
    "remove_urls": on_text(urls("text")),
    "remove_mentions": on_text(replaced("text", MENTION, USER_TOKEN)),
    "normalize_hashtags": on_text(replaced("text", HASHTAG, r"\1")),
    "to_lowercase": on_text("lower(text)"),
    "handle_emojis": on_text(named("text", POST_EMOJI_NAMES)),
    "emoji_fixture": (
        f"WITH other AS (SELECT doc_id AS id, {EMOJI_TEXT} AS text FROM documents)"
        f" SELECT id, {named('text', OTHER_EMOJI_NAMES)} AS text FROM other"
    ),
    "preview": (
        f"{TEXTS} SELECT id, CASE WHEN length(text) > 150 THEN substring(text, 1, 150) || '...'"
        " ELSE text END AS preview, substring(text, 1, 80) || '...' AS mismatch_preview FROM texts"
    ),
    "text_lengths": (
        f"{TEXTS} SELECT id, CAST(length(text) AS INTEGER) AS n_chars,"
        f" {count_of('text', WORD, 'INTEGER')} AS n_words FROM texts"
    ),
    "noise_flags": f"{TEXTS} SELECT id, " + ", ".join(
        f"{matches(pattern)} AS has_{name}" for name, pattern in NOISE.items()
    ) + " FROM texts",
    "batch_map": f"{TEXTS} SELECT id, split, CAST(length(text) AS BIGINT) AS n_points FROM texts",
    "token_counts": on_text(count_of("text", TOKEN, "INTEGER"), "n_tokens"),
    "vocabulary": f"{TEXTS}, {VOCABULARY} SELECT token, n, token_id FROM vocabulary",
    "encode_tokens": encoded(MAX_LENGTH),
    "token_frequencies": (
        f"{TEXTS}, words AS (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS token"
        " FROM texts WHERE split = 'train') SELECT token, count(*) AS n FROM words GROUP BY token"
    ),
    "split_counts": f"{POSTS} SELECT split, count(*) AS n_rows FROM posts GROUP BY split",
    "class_balance": (
        f"{POSTS} SELECT split, {label_name()} AS label_name, count(*) AS n_rows,"
        " count(*) / sum(count(*)) OVER (PARTITION BY split) * 100 AS pct FROM posts GROUP BY split, label"
    ),
    "classes_by_count": (
        f"{POSTS}, balance AS (SELECT split, {label_name()} AS label_name, count(*) AS n_rows,"
        " count(*) / sum(count(*)) OVER (PARTITION BY split) * 100 AS pct FROM posts GROUP BY split, label)"
        " SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY n_rows, label_name) AS INTEGER)"
        " AS place FROM balance"
    ),
    "length_stats": (
        f"{TEXTS}, l AS (SELECT split, length(text) AS c, {WORD_COUNT} AS w FROM texts)"
        " SELECT split, round_even(avg(c), 1) AS chars_mean, round_even(median(c), 1) AS chars_median,"
        " max(c) AS chars_max, round_even(quantile_cont(c, 0.95), 1) AS chars_p95,"
        " round_even(avg(w), 1) AS words_mean, round_even(median(w), 1) AS words_median"
        " FROM l GROUP BY split"
    ),
    "length_histogram": f"{TEXTS}, {LENGTHS}, " + histogram("lengths", "split, ", "20"),
    "token_quantiles": (
        f"{TEXTS}, l AS (SELECT {TOKEN_COUNT} AS v FROM texts) SELECT"
        " quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.99) AS p99 FROM l"
    ),
    "token_histogram": (
        f"{TEXTS}, lengths AS (SELECT 'tokens' AS metric, {TOKEN_COUNT} AS value FROM texts), "
        + histogram("lengths", "", AUTO_BINS)
    ),
    "noise_profile": noise_profile(),
    "sample_per_class": sample(5),
    "sample_2000_per_class": sample(2000),
    "head_rows": f"{POSTS} SELECT id, label, split, text FROM posts ORDER BY id LIMIT 5",
    "eval_subset": f"{SCORED} SELECT id, label, pred FROM {FIRST_TEST}",
    "argmax_pred": f"{SCORED} SELECT id, label, pred FROM predicted",
    "eval_metrics": (
        f"{SCORED}, {class_metrics('predicted')} SELECT round(sum(tp) / sum(support), {DIGITS}) AS accuracy,"
        f" round(avg(f), {DIGITS}) AS f1_macro FROM measured"
    ),
    "confusion_matrix": (
        f"{SCORED}, listed AS (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS label)"
        " SELECT label, " + ", ".join(
            f"count(*) FILTER (pred = {k}) AS pred_{k}" for k in range(len(LABEL_NAMES))
        ) + " FROM listed LEFT JOIN predicted USING (label) GROUP BY label"
    ),
    "classification_report": report("predicted"),
    "baseline_report": report(FIRST_TEST),
    "parity_check": (
        f"{OUTPUTS} SELECT CAST(count(*) AS BIGINT) AS n_left, CAST(count(*) AS BIGINT) AS n_right,"
        " (SELECT count(*) FROM keys) = 0 AS all_match,"
        " (SELECT count(*) FROM keys) AS mismatch_count FROM outputs"
    ),
    "parity_mismatches": (
        f"{OUTPUTS} SELECT id, left_text, right_text FROM keys ORDER BY id NULLS FIRST LIMIT 3"
    ),
    "parity_by_position": (
        f"{BY_POSITION} SELECT CAST(count(*) AS BIGINT) AS n_left, CAST(count(*) AS BIGINT) AS n_right,"
        " (SELECT count(*) FROM keys) = 0 AS all_match,"
        " (SELECT count(*) FROM keys) AS mismatch_count FROM outputs"
    ),
    "position_mismatches": (
        f"{BY_POSITION} SELECT id AS row_index, left_text, right_text FROM keys ORDER BY id LIMIT 3"
    ),
}
