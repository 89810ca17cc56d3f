"""SQL for DuckDB that gives the rows of the queries that SQL can express.

The patterns are written out here in their plain form, and windows and pairs are formed
one by one, so that the SQL shares nothing with the operators.
"""

from __future__ import annotations

BLANKS = r"[^\x20\x09-\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{BLANKS}')"

# kind, pattern, group whose length counts, least length, whether it is a base kind
KINDS = [
    ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
               r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?"
               r"([A-Za-z0-9+/_.=-]+)", 1, 8, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", r"[0-9a-f]+", 0, 32, True),
    ("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    ("url_login", r"://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]{4,}@", 0, 1, False),
]


def secrets() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {place} AS place, {str(base).lower()} AS base,"
        f" unnest(string_split_regex(t, '{pattern}')) AS gap,"
        f" unnest(regexp_extract_all(t, '{pattern}')) AS hit,"
        f" unnest(regexp_extract_all(t, '{pattern}', {group})) AS value, {least} AS least,"
        f" unnest(range(1 + len(regexp_extract_all(t, '{pattern}')))) AS turn FROM texts"
        for place, (kind, pattern, group, least, base) in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
                       for kind, *_, base in KINDS if base)
    listed = "string_agg(concat(kind, ':', b, ':', e), ',' ORDER BY b, place, e)"
    return (
        "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
        f" found AS ({found}),"
        " placed AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id,"
        " place ORDER BY turn) AS e FROM found),"
        " spans AS (SELECT doc_id, kind, place, base, CAST(e AS BIGINT) AS e,"
        " CAST(e - length(hit) AS BIGINT) AS b FROM placed"
        " WHERE hit IS NOT NULL AND length(value) >= least),"
        f" sums AS (SELECT doc_id, {counts}, {listed} FILTER (base) AS base, {listed} AS spans"
        " FROM spans GROUP BY doc_id)"
        " SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,"
        " coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,"
        " coalesce(spans, '') AS spans, sha256(t) AS blob_id FROM texts LEFT JOIN sums USING (doc_id)"
    )


def passages(window: int = 50) -> str:
    return (
        f"WITH texts AS (SELECT doc_id, {WORDS} AS w FROM documents),"
        f" starts AS (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS s FROM texts),"
        f" runs AS (SELECT doc_id, s, md5(array_to_string(w[s:s + {window - 1}], ' ')) AS run FROM starts),"
        " firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),"
        " hits AS (SELECT doc_id, s FROM runs JOIN firsts USING (run) WHERE first < doc_id),"
        f" gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS spot FROM hits),"
        " spots AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS spot FROM texts),"
        " marked AS (SELECT s.doc_id, s.spot, word, g.spot IS NOT NULL AS lost FROM spots s"
        " LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.spot = g.spot),"
        " sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (lost) AS n_removed,"
        " string_agg(word, ' ' ORDER BY spot) FILTER (NOT lost) AS kept FROM marked GROUP BY doc_id)"
        " SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,"
        " sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN sums USING (doc_id)"
    )


def jaccard(size: int = 3, num: int = 9, den: int = 10) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    lowered = WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{letters.upper()}', '{letters}')")
    return (
        f"WITH RECURSIVE texts AS (SELECT doc_id, {lowered} AS w FROM documents),"
        f" worded AS (SELECT doc_id, w, least(len(w), {size}) AS k FROM texts WHERE len(w) > 0),"
        " starts AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM worded),"
        " shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + k - 1], ' ') AS g FROM starts),"
        " sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),"
        " shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b"
        " ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),"
        " links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b"
        f" WHERE {den} * m >= {num} * (x.n + y.n - m)),"
        " near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),"
        " reach AS (SELECT doc_id AS a, doc_id AS b FROM documents"
        " UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b),"
        " lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)"
        " SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents"
        " LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON a IS NOT DISTINCT FROM doc_id"
    )


def periodic_runs() -> str:
    """CRC-32 is folded byte by byte and bit by bit.  Words that equal those q words later
    for at least five words in turn are found by their five-word windows."""
    bit = "lambda c, k: xor(c >> 1, 3988292384 * (c & 1))"
    byte = f"lambda c, x: list_reduce(list_prepend(xor(c, x), [0,0,0,0,0,0,0,0]::BIGINT[]), {bit})"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), {byte}), 4294967295)"
    return (
        f"WITH texts AS (SELECT doc_id, {WORDS} AS w, {crc} AS h FROM documents),"
        " planned AS (SELECT *, len(w) AS n, h // 10 AS g FROM texts),"
        " placed AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM planned),"
        " cycles AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),"
        " docs AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN"
        " list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END])"
        " ELSE w END AS w FROM cycles),"
        " starts AS (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM docs WHERE n >= 6),"
        " windows AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 5], ' ')) AS five FROM starts),"
        " equal AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM windows x JOIN windows y"
        " ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),"
        " turns AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS turn FROM equal),"
        " stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM turns"
        " GROUP BY doc_id, q, turn),"
        " runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches"
        " WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),"
        " lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period,"
        " chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),"
        " longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id"
        " ORDER BY length DESC, start, period) = 1),"
        " gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS spot FROM runs),"
        " spots AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM docs),"
        " kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.spot) AS words FROM spots s"
        " LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.spot = g.spot WHERE g.spot IS NULL GROUP BY s.doc_id)"
        " SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, length, period,"
        " 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,"
        " sha256(coalesce(words, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words FROM docs"
        " LEFT JOIN lines USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)"
    )


def search(top: int = 10, slope: int = 75) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    listed = (f"unnest(regexp_extract_all(translate(text, '{letters.upper()}', '{letters}'),"
              f" '{pattern}')) AS term")
    return (
        f"WITH words AS (SELECT doc_id, {listed} FROM documents WHERE text IS NOT NULL),"
        " counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),"
        " sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),"
        " corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),"
        f" wanted AS (SELECT item_id, {listed} FROM benchmark WHERE text IS NOT NULL),"
        " asked AS (SELECT item_id, term, count(*) AS times FROM wanted GROUP BY ALL),"
        " weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1)))"
        " AS BIGINT) AS w FROM counts, corpus GROUP BY term, docs),"
        f" lengths AS (SELECT doc_id, {100 - slope} + ({slope} * n * docs) // terms AS m FROM sizes, corpus),"
        " scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))"
        " AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN counts USING (term)"
        " JOIN lengths USING (doc_id) GROUP BY ALL)"
        " SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)"
        " AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0"
        f" QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {top}"
    )


def exact() -> str:
    return (
        r"WITH texts AS (SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace("
        r"coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),"
        " ranked AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"
        " AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM texts)"
        " SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked"
    )


ORACLE: dict[str, str] = {
    "op3_phrase_automata": passages(),
    "op5_secret_ledger": secrets(),
    "op7_parity_sketch_join": jaccard(),
    "op11_dyadic_square_catching": periodic_runs(),
    "op12_bag_search": search(),
    "op13_streaming_exact_dedup": exact(),
}
