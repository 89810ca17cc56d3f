"""Quality, decontamination, toxicity and pages."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from brevia.llm import decontamination, features, pages, quality, toxicity
from brevia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def base_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    marked = {i for k in range(len(words) - 2) if runs[tuple(words[k:k + 3])] > 1
              for i in (k, k + 1, k + 2)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    dups = sum(line in lines[:k] for k, line in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked))


def test_base_measures(spark, make_docs, odd_rows):
    rows = [*odd_rows, (1, "a b c a b c a"), (2, "x\nx\n\nx \n  \nx"), (3, "# * |a| <b> é😀 \xa0x"),
            (4, "a a a a"), (1, "a b c a b c a")]
    found = quality.measured(make_docs(rows, True)).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[m] for m in quality.MEASURES[:5]) == base_measures(texts[r["doc_id"]])


def test_quality_query(spark):
    found = {r["doc_id"]: r for r in QUERIES["op10_weak_supervision"](spark, SF).collect()}
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/labels.parquet")
              .select("doc_id", "quality").collect()}
    good = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        row, (n, *rest) = found[r["doc_id"]], base_measures(r["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"],
                row["n_repeat_words"]) == (n, *rest)
        assert row["base_failed"] == (n < 50 or 100 * rest[3] > 50 * n)
        assert not (row["base_failed"] and row["kept"])
        if labels.get(r["doc_id"]) == 1 and not row["base_failed"]:
            good.append(row["kept"])
    assert len(good) > 10 and np.mean(good) > 0.97


def test_estimation_finds_accuracies():
    draw = np.random.default_rng(1)
    right = [0.95, 0.9, 0.85, 0.6]
    counts = Counter()
    truth = draw.random(20_000) < 0.7
    for good in truth:
        votes = ""
        for chance in right:
            if draw.random() < 0.2:
                votes += "0"
            else:
                votes += "+" if (draw.random() < chance) == good else "-"
        counts[votes] += 1
    model = quality.fit(counts, 4)
    assert model.prior == pytest.approx(0.7, abs=0.03)
    for rule, chance in enumerate(right):
        assert model.chances[rule, 1, 1] == pytest.approx(chance, abs=0.04)
        assert model.chances[rule, 0, 0] == pytest.approx(chance, abs=0.06)
    assert model.posterior("++++") > 0.9 > 0.1 > model.posterior("---0")


def test_quality_of_nothing(make_docs):
    assert quality.judged(quality.measured(make_docs([]))).count() == 0
    rows = quality.judged(quality.measured(make_docs([(1, None), (2, "")]))).collect()
    assert all(r["votes"][0] == "-" for r in rows)


def distance(pattern, text):
    """Least edits to any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for p in pattern:
        last, row = row, [row[0] + 1]
        for k, t in enumerate(text):
            row.append(min(last[k] + (p != t), last[k + 1] + 1, row[k] + 1))
    return min(row)


def test_myers_equals_table():
    draw = np.random.default_rng(2)
    for _ in range(150):
        pattern = "".join(draw.choice(list("abc "), draw.integers(1, 90)))
        text = "".join(draw.choice(list("abc "), draw.integers(0, 120)))
        if draw.random() < 0.5:
            text += pattern[:40] + "x" + pattern[41:]
        assert decontamination.Pattern(1, pattern, 0.1).nearest(text)[0] == distance(pattern, text)


def test_matches_equal_plain_search(spark, make_docs, words, odd_rows):
    draw = np.random.default_rng(4)
    items = [(k, " ".join(words(int(draw.integers(3, 60)), 300 + k))) for k in range(8)]
    items += [(90, None), (91, " "), (92, items[0][1])]
    docs = []
    for key in range(40):
        text = list(items[key % 8][1])
        for at in draw.integers(0, len(text), int(draw.integers(0, 20))):
            text[at] = draw.choice(["", "x", "yz"])
        docs.append((key, f"{' '.join(words(20, key))}\n{''.join(text).upper()}\t"
                          f"{' '.join(words(20, 99 + key))}"))
    docs += odd_rows
    table = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    found = decontamination.matches(make_docs(docs, True), table).collect()
    truth = set()
    for key, text in docs:
        for item, wanted in items:
            plain = decontamination.plain(wanted)
            if plain and len(text or "") < 10_000:
                budget = decontamination.Pattern(item, plain, decontamination.ERROR_RATE).errors
                near = distance(plain, decontamination.plain(text))
                if near <= budget:
                    truth.add((key, item, near))
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in found} == truth and truth
    kept = decontamination.without_contaminated(make_docs(docs, True), table)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - {t[0] for t in truth}
    assert "score" in kept.columns
    none = table.filter("false")
    assert decontamination.matches(make_docs(docs), none).count() == 0
    assert decontamination.without_contaminated(make_docs(docs), none).count() == len(docs)
    assert decontamination.matches(make_docs([]), table).count() == 0


def test_items_in_several_blocks_are_all_found(spark, words):
    items = [(k, " ".join(words(30, k))) for k in range(30)]
    table = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    blocks = list(decontamination.item_blocks(table, "item_id", "text", 1000))
    assert len(blocks) > 3 and sorted(i for b in blocks for i, _ in b) == list(range(30))


def test_items_without_id_or_with_text_ids(spark, make_docs, words):
    one, two = " ".join(words(9, 1)), " ".join(words(9, 2))
    docs = make_docs([(1, f"{one} and {two}"), (2, two), (3, "neither of them")])
    for kind, first, second in (("BIGINT", None, 5), ("STRING", "a-1", None)):
        table = spark.createDataFrame([(first, one), (second, two), (second, two)],
                                      f"item_id {kind}, text STRING")
        rows = decontamination.matches(docs, table)
        assert rows.schema["item_id"].dataType == table.schema["item_id"].dataType
        assert sorted((r["doc_id"], r["item_id"] or 0) for r in rows.collect() if r["doc_id"] == 2) == [
            (2, second or 0)] * 2
        assert rows.filter("doc_id = 1").count() == 3 and rows.filter("doc_id = 3").count() == 0
        kept = decontamination.without_contaminated(docs, table).collect()
        assert [r["doc_id"] for r in kept] == [3]
    assert len(decontamination.Matcher([(None, one), (1, one)])(one)) == 2


def test_tiny_items_are_no_evidence(spark, make_docs):
    docs = make_docs([(1, "a party of cats"), (2, "exactly twenty chars")])
    table = spark.createDataFrame([(1, "a"), (2, "cats"), (3, "exactly twenty chars")],
                                  "item_id BIGINT, text STRING")
    assert [r["doc_id"] for r in decontamination.without_contaminated(docs, table).collect()] == [1]
    found = decontamination.matches(docs, table, least=4).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, found)) == [(1, 2), (2, 3)]


def test_toxic_documents_are_found(spark, make_docs, words):
    docs = [(k, " ".join(words(60, k) + ["horrid", "vile"] * (k % 4 == 0) + words(60, 500 + k)))
            for k in range(400)]
    labels = spark.createDataFrame([(k, 1 - k % 2, int(k % 4 == 0)) for k in range(300)],
                                   "doc_id BIGINT, quality INT, toxic INT")
    chain = toxicity.train(make_docs(docs), labels)
    assert [link.category for link in chain] == list(toxicity.CATEGORIES)
    odd = [(900, None), (901, ""), (902, "vile horrid " * 9), (902, "vile horrid " * 9)]
    rows = toxicity.predict(make_docs([*docs[300:], *odd], True), chain).collect()
    for r in rows:
        if r["doc_id"] < 900:
            assert r["is_toxic"] == (r["doc_id"] % 4 == 0)
    assert [r["is_toxic"] for r in rows if r["doc_id"] >= 900] == [False, False, True, True]


def test_toxicity_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT")
    rows = toxicity.predict(make_docs([(1, "a")]), toxicity.train(make_docs([(1, "a")]), none)).collect()
    assert [(r["p_toxic"], r["is_toxic"]) for r in rows] == [(0.0, False)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu {0}</a></li></ul></nav>
<div class="cookie-notice">We use cookies {0}</div><script>var t="</p><p>no";</script>
<article><header><h1>Head &amp; {0}</h1></header><p>One <b>bold{0}</b> text<br>next &eacute;
line<p>Two<div class="ad-box">Buy {0}</div><form><p>Mail</p></form>
<aside>Side</aside></article><section id="comments"><article><p>Nice!</p></article></section>
<footer>&copy; {0}</footer>"""


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    return {r["page_id"]: r["blocks"] for r in
            pages.extract(df.selectExpr("*", "'x' AS text", "1 AS host")).collect()}


def test_article_without_what_is_beside_it(spark):
    got = extracted(spark, [(k, f"https://A.example/{k}", PAGE.format(k)) for k in range(3)])
    for k in range(3):
        assert got[k] == [f"Head & {k}", f"One bold{k} text next é line", "Two"]


def test_template_texts_and_links_go_where_there_is_no_article(spark):
    page = ("<body><div><p>Welcome to our site</p><p>Body {0} says much about {0}</p>"
            "<ul><li><a href=x>Link {0}</a></li></ul><p>All rights reserved</p></div></body>")
    got = extracted(spark, [(k, "http://b.example/x", page.format(k)) for k in range(6)])
    assert got == {k: [f"Body {k} says much about {k}"] for k in range(6)}
    lone = extracted(spark, [(1, None, page.format(1))])
    assert lone[1][0] == "Welcome to our site"  # nothing to compare with


def test_odd_pages(spark):
    got = extracted(spark, [(1, "http://c.example", None), (2, None, ""), (3, "x", "plain < text"),
                            (4, "http://c.example/", "</p></div><p>a<p>b</article>"),
                            (5, "http://c.example/", "<div class='ad'>x<article><p>kept</p>"),
                            (6, "http://d.example", "<p>" + "w " * 50_000 + "<!-- open")])
    assert got[1] == [] and got[2] == [] and got[3] == ["plain < text"]
    assert got[4] == ["a", "b"] and got[5] == ["kept"] and len(got[6][0]) == 99_999
    assert extracted(spark, []) == {}


def test_pages_query(spark):
    rows = QUERIES["op2_template_deduction"](spark, SF).collect()
    html = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    assert len(rows) == len(html)
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        assert "<article>" not in html[r["page_id"]] or r["text"]
        assert "&" not in re.sub(r"&&&", "", r["text"]) or "&amp;" in html[r["page_id"]]


def test_copies_of_an_article_are_not_its_template(spark):
    inside = "<body><article><h1>One</h1><p>Two words</p></article></body>"
    bare = "<body><div><h1>One</h1><p>Two words</p></div></body>"
    rows, wanted = [], {}
    for n in (19, 20, 1000):
        for host, page in (("in", inside), ("bare", bare)):
            for url in (f"http://{host}{n}.example/?q=", None, "no/host/"):
                for k in range(n):
                    wanted[len(rows)] = ["One", "Two words"]
                    rows.append((len(rows), url and f"{url}{k}", page))
    # Copies with a small change: the text that they share is theirs.
    long = "<body><article><h1>" + "shared words " * 9 + "</h1><p>Seen {0} times</p></article></body>"
    for k in range(40):
        rows.append((len(rows), f"http://near.example/{k}", long.format(k)))
        wanted[len(rows) - 1] = [("shared words " * 9).strip(), f"Seen {k} times"]
    # Different articles that share a small text.
    other = "<body><article><h1>Word" + " word{0}" * 9 + "</h1><p>Share it</p></article></body>"
    for k in range(40):
        rows.append((len(rows), f"http://differ.example/{k}", other.format(k)))
        wanted[len(rows) - 1] = ["Word" + f" word{k}" * 9]
    assert extracted(spark, rows) == wanted


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>"])
def test_names_that_hold_such_a_word_lose_no_text(around):
    text = ("<h2 id='related-work'>Related work</h2><p id='notice-period'>A notice</p>"
            "<section id='search-algorithms'><p>Searching</p></section>"
            "<p>The <span class='share-price'>price</span> is <em class='ad-hoc'>new</em>"
            " <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><xmp><b>&amp;</xmp>")
    wanted = ["Related work", "A notice", "Searching", "The price is new x=2", "<b>&amp;"]
    for page in ("<body class='has-sidebar'>{}</body>", "<body><div id='page' class='search-on'>{}</div>",
                 "<body><div class='ad'>Buy</div><div class='cookie-notice'>Yes</div>{}</body>"):
        html = page.format(around.format(text))
        assert [b.text for b in pages.blocks_of(html) if not b.out] == wanted


BARE = """<html><body><div><div><a href=x>Start {0}</a> <a href=y>News {1}</a></div></div>
{ad}<div><div><h1>Title {0}</h1><p>First {text}</p><div><p>Second {text}</p></div>
<p>Third {1}</p></div><div>Sold here: {1} cheap things</div></div>
<div><p>Owned by {host} since {1}</p></div></body></html>"""


def test_unnamed_varying_menus_and_adverts_are_found_by_the_template(spark, words):
    rows, wanted = [], {}
    for host in ("one.example", "two.example"):
        for k in range(12):
            text = " ".join(words(40, k))
            ad = f"<div><p>Buy number {k * 7} now</p></div>" if k % 3 == 0 else ""
            rows.append((len(rows), f"http://{host}/{k}",
                         BARE.format(k, k + 1, ad=ad, text=text, host=host)))
            wanted[len(rows) - 1] = [f"Title {k}", f"First {text}", f"Second {text}", f"Third {k + 1}"]
    assert extracted(spark, rows) == wanted


def test_a_notice_that_is_longer_than_the_articles_is_not_the_article(spark, words):
    notice = " ".join(words(200, 1))
    page = "<body><div>{0}</div><div><div><h1>Title {1}</h1><p>{2}</p></div></div></body>"
    rows = [(k, f"http://n.example/{k}", page.format(notice, k, " ".join(words(60, 9 + k))))
            for k in range(12)]
    assert extracted(spark, rows) == {
        k: [f"Title {k}", " ".join(words(60, 9 + k))] for k in range(12)}
    # A host with one page has nothing that tells the notice from an article.
    assert extracted(spark, rows[:1]) == {0: [notice]}


def test_a_hosts_articles_grow_without_a_switch(spark):
    page = "<body><article><h1>Title {0}</h1><p>We all quote this line</p><p>{1}</p></article></body>"
    for n in (2, 5, 10):  # no evidence against a shared line in so few articles
        rows = [(k, f"http://q{n}.example/{k}", page.format(k, f"own{k} " * 20)) for k in range(n)]
        assert all(len(blocks) == 3 for blocks in extracted(spark, rows).values())


def test_classes_must_come_in_one_order_and_be_nested(spark):
    def valid(*orders):
        struct = spark.createDataFrame([("h", str(k), list(o)) for k, o in enumerate(orders)],
                                       "host STRING, row STRING, elements ARRAY<BIGINT>")
        vectors = {1: 10, 2: 10, 3: 30, 4: 30}
        elements = spark.createDataFrame([("h", t, v) for t, v in vectors.items()],
                                         "host STRING, token BIGINT, vector BIGINT")
        hosts = spark.createDataFrame([("h", len(orders))], "host STRING, all_pages BIGINT")
        found = pages.in_classes(struct, pages.Dealt(hosts), elements)
        return sorted(r["vector"] for r in found.collect())

    assert valid([1, 3, 4, 2], [1, 3, 4, 2], [1, 2]) == [10, 30]
    assert valid([1, 2, 3, 4], [1, 2, 9, 3, 4]) == [10, 30]
    assert valid([1, 2, 3, 4], [2, 1, 3, 4]) == [30]
    assert valid([1, 3, 2, 4], [1, 3, 2, 4]) == []


def test_deep_pages_take_linear_time():
    begin = time.perf_counter()
    blocks = pages.blocks_of("<div>" * 40_000 + "<p>deep</p>" + "</b></i>" * 20_000)
    assert [b.text for b in blocks] == ["deep"] and time.perf_counter() - begin < 10
    assert pages.main_blocks("<div>" * 40_000 + "<p>deep</p>", set(), None, set()) == ["deep"]


def test_of_conflicting_labels_the_least_counts(spark, make_docs):
    rows = [(1, 1, 0), (1, 0, 1), (1, 0, 0), (2, None, 1), (2, 0, 0), (None, 1, 1)]
    docs = make_docs([(1, "one"), (2, "two"), (3, "three")])
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id BIGINT, quality INT, toxic INT")
        got = features.labelled_sample(docs, labels.repartition(3), "doc_id", "text").select(
            "doc_id", "text", "quality", "toxic").collect()
        assert sorted(map(tuple, got)) == [(1, "one", 0, 0), (2, "two", None, 1)]


def test_sample_has_few_parts_whatever_the_documents_have(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(200)]).repartition(40)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id BIGINT, quality INT, toxic INT")
    sample = features.labelled_sample(docs, labels, "doc_id", "text")
    assert sample.rdd.getNumPartitions() == features.SAMPLE_PARTS
    assert sorted(r["doc_id"] for r in sample.collect()) == list(range(200))
