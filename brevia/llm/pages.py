"""Main text of web pages by template deduction with equivalence classes.

A page is read as a tree of elements.  Its block elements that hold others, such as div,
section or td, are tokens, named by the labels on the way to them and by their place among
siblings of one label; a text at its path is a token too.  Over the pages of a host:

1. Every token has an occurrence vector: how often it is on each page.  Tokens of one
   vector are an equivalence class.
2. A class is valid if its elements come in one order on all pages that have them, and if
   it is nested: between two of its elements another class is there as a whole or not.
   Only elements of valid classes that are on two pages or more make up the template.
3. What stands between the template's elements are its slots.  A slot has the share of its
   text that is in links, and its variety: the characters of its distinct texts to all.
4. Texts whose vector is that of a valid class are the template's own, unless most of what
   the host's articles say is: then the pages are copies with small changes.
5. A page's article fills the slots below one element of the template.  From the page's
   root the way goes to the element with more than half of the text, each text weighed by
   the variety of its slot, as long as there is one.  Whole elements beside this way go,
   paragraphs and headings directly on it stay.  Slots of links mostly go.

Tags and names are a prior.  An article or main element is taken as the element of step 5;
what is in a nav, aside, form or the like, or in an element with a whole name such as
``comments``, is beside the article.  Names decide nothing where they would take nearly all
of a page.

A vector is an exclusive or of hashes of (page, count): equal vectors have equal sums, and
sums of parts can be combined before they are sent, so no page has to meet another one.
Pages of a host that has many are dealt to several tasks.  Pages are read in time that is
linear in their length, however deep their elements are nested.

* Null html: empty text.  Null address or one without a host: the page has no template
  to compare with; its own elements are the way of step 5.
* A host with one page, or a page with no element of its host's template: the same.
* Copies of one page tell nothing of a template: texts are fixed by evidence that grows
  with the number of different contents (``most_fixed``), none with two or less.
* Repeated rows: each is a page.
* Broken markup: end tags without a start are ignored, open elements end with their parent.
* An empty table: no rows.
* Columns beside id, url and html are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
RAW = frozenset(
    "script style textarea noscript template iframe xmp svg annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr br img math maction menclose"
    " merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace"
    " msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
# Block elements that hold a text; a part of their name says what it is about.
HOLDS_TEXT = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th caption figcaption".split())
# Those of them that are data, never a part of a template.
DATA = frozenset("p h1 h2 h3 h4 h5 h6 dt pre caption figcaption".split())
NOT_TEXT = frozenset(
    "head title nav header footer aside form button select option menu dialog object canvas"
    " audio video fieldset input".split()) | RAW
# Parts of a class, id or role that name something beside the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner"
    " nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead"
    " cookie cookies consent notice notices notification popup modal overlay subscribe"
    " newsletter signup login comment comments reply replies respond discussion disqus related"
    " recommended share sharing social widget pagination pager toolbar search skip copyright"
    " complementary contentinfo alert gdpr paywall".split())
ROOTS = frozenset(("article", "main"))
ROOT_NAMES = frozenset(("article", "main", "articlebody"))
CLOSES = {  # a start tag ends open elements of these kinds, up to the nearest of the others
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_CLOSES = ({"p"}, {"body", "td", "th", "button"} | ROOTS)  # other blocks end a paragraph
ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>|\Z", re.I) for tag in RAW}
# The share of a page's text that an element's name may not take, and the shares that the
# texts of a template may have of what a host's pages say, outside and inside an article.
MOST_SHARE, FIXED_SHARE, FIXED_IN_ARTICLE = 0.9, 0.93, 0.5
# Contents whose agreement is no evidence yet, outside and inside an article.
CHANCE, CHANCE_IN_ARTICLE = 2, 10
HEAVY = 200  # hosts with more than a 200th of the pages are dealt to several tasks


class Node(NamedTuple):
    tag: str
    parent: int
    start: int
    names: list[tuple[str, str]]
    path: int  # the tags on the way to it
    token: int  # the labels and places on the way to it
    container: int  # the nearest node that is a token, itself included


class Block(NamedTuple):
    path: int
    text: str
    linked: int  # characters inside links
    out: bool  # beside the article
    root: bool  # in the article's element
    node: int = 0  # the container


class Page(NamedTuple):
    nodes: list[Node]
    blocks: list[Block]


def named(attributes: str) -> list[tuple[str, str]]:
    """(attribute, name in lower case) of an element's class, id, role and itemprop."""
    return [(kind.lower(), name) for kind, value in NAMES.findall(attributes)
            for name in value.strip("\"'").lower().split()] if attributes else []


def put_beside(tag: str, names: list[tuple[str, str]], root: bool) -> tuple[bool, bool]:
    """Whether an element's names put it beside the article: whole ones, parts of them.

    Inline elements in an article and the body never are.  Parts count for elements that
    hold blocks only, and parts of an id, which is often an anchor, for those outside an
    article and not for sections."""
    if tag in ("html", "body") or tag in INLINE and root:
        return False, False
    whole = any(name in NOT_ARTICLE for _, name in names)
    if whole or tag in INLINE or tag in HOLDS_TEXT:
        return whole, False
    return False, any(not NOT_ARTICLE.isdisjoint(NAME_PARTS.findall(name)) for kind, name in names
                      if kind != "id" or not root and tag != "section")


def label(tag: str, names: list[tuple[str, str]]) -> str:
    """A tag with its classes; digits in them, often a page's number, do not count."""
    kinds = sorted({re.sub(r"\d+", "", name) for kind, name in names if kind == "class"})
    return ".".join([tag, *kinds])


def tree_of(html: str) -> tuple[list[Node], list[tuple[int, list]]]:
    """A page's elements in order, and its blocks of text: (node, pieces), a piece being
    (text, whether in a link, node)."""
    nodes = [Node("", 0, 0, [], 0, 0, 0)]
    places: list[Counter | None] = [None]  # children by label
    stack = [0]
    opened: dict[str, list[int]] = {}  # depths of the open elements by tag
    blocks: list[tuple[int, list]] = []
    parts: list[tuple[str, bool, int]] = []
    links = at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            blocks.append((stack[-1], parts))
            parts = []

    def close(depth: int) -> None:
        for node in stack[depth:]:
            opened[nodes[node].tag].pop()
        del stack[depth:]

    def deepest(tags: set[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    while found := MARKUP.search(html, at):
        if found.start() > at:
            parts.append((html[at:found.start()], links > 0, stack[-1]))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append((" ", False, stack[-1]))
            continue
        if tag not in INLINE:
            flush()
        if found[1]:
            links -= tag == "a" and links > 0
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in RAW:
            end = ENDS[tag].search(html, at)
            if tag == "xmp":
                parts.append((references.escape(html[at:end.start()]), links > 0, stack[-1]))
                flush()
            at = end.end()
            continue
        links += tag == "a"
        if tag in VOID:
            continue
        if tag in CLOSES or tag not in INLINE:
            kinds, limits = CLOSES.get(tag, P_CLOSES)
            depth = deepest(kinds)
            if depth > deepest(limits):
                close(depth)
        above = stack[-1]
        parent, names, here = nodes[above], named(found[3]), len(nodes)
        if tag in INLINE:
            node = Node(tag, above, found.start(), names, parent.path, parent.token, parent.container)
        else:
            path = token(str(parent.path), tag)
            if tag in DATA:
                node = Node(tag, above, found.start(), names, path, parent.token, parent.container)
            else:
                kind, holder = label(tag, names), parent.container
                count = places[holder] = places[holder] or Counter()
                count[kind] += 1
                node = Node(tag, above, found.start(), names, path,
                            token(str(nodes[holder].token), kind, str(count[kind])), here)
        nodes.append(node)
        places.append(None)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(here)
    if at < len(html):
        parts.append((html[at:], links > 0, stack[-1]))
    flush()
    return nodes, blocks


def judged(nodes: list[Node], passed: frozenset[int]) -> tuple[list[bool], ...]:
    """By tags and names, for each element: beside the article, in the article's element,
    never its text, put beside by a part of its name.  The names of ``passed`` are skipped."""
    out, root, never, partly = [False], [False], [False], [False]
    begun = False  # whether an article has been met
    for at, node in enumerate(nodes[1:], 1):
        in_root, out_above = root[node.parent], out[node.parent]
        whole, part = put_beside(node.tag, node.names, in_root)
        part = part and at not in passed
        by_tag = node.tag in NOT_TEXT and not (node.tag == "header" and in_root)
        beside = by_tag or whole or part
        article = not beside and (node.tag in ROOTS or any(
            not ROOT_NAMES.isdisjoint(NAME_PARTS.findall(name)) for _, name in node.names))
        # If a page's first article starts inside something beside it, that was left open.
        astray = out_above and article and node.tag in ROOTS and not begun
        out.append(beside or out_above and not astray)
        begun = begun or article and not out[-1]
        root.append(in_root or article)
        never.append(never[node.parent] and not astray or by_tag or whole)
        partly.append(part)
    return out, root, never, partly


def sums_above(nodes: list[Node], sums: list[float]) -> list[float]:
    """Sums of each element with all below it."""
    for at in range(len(nodes) - 1, 0, -1):
        sums[nodes[at].parent] += sums[at]
    return sums


def read_page(html: str | None) -> Page:
    """A page's elements and its blocks of text in order, white space and references resolved.

    If a page has no article and nearly all of its text is in an element that a part of
    its name would put beside, that name is passed over."""
    nodes, raw = tree_of(html or "")

    def resolved(out: list[bool], root: list[bool]) -> list[Block]:
        blocks = []
        for top, pieces in raw:
            for beside in (False, True):
                held = [(p, linked) for p, linked, node in pieces if out[node] == beside]
                line = " ".join(references.unescape("".join(p for p, _ in held)).split())
                if line:
                    blocks.append(Block(nodes[top].path, line, sum(len(p) for p, k in held if k),
                                        beside, root[top], nodes[top].container))
        return blocks

    out, root, never, partly = judged(nodes, frozenset())
    blocks = resolved(out, root)
    if any(partly) and not any(b.root and not b.out for b in blocks):
        sizes = [0.0] * len(nodes)
        for _, pieces in raw:
            for piece, linked, node in pieces:
                if not linked and not never[node]:
                    sizes[node] += len(piece.strip())
        sizes = sums_above(nodes, sizes)
        passed = frozenset(at for at, part in enumerate(partly)
                           if part and sizes[at] >= MOST_SHARE * sizes[0] > 0)
        if passed:
            out, root, _, _ = judged(nodes, passed)
            blocks = resolved(out, root)
    return Page(nodes, blocks)


def blocks_of(html: str | None) -> list[Block]:
    return read_page(html).blocks


def token(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def text_token(block: Block) -> int:
    return token(str(block.path), block.text)


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of a page's article, or if it has none, those that are not beside it
    nor links mostly."""
    held = [b for b in blocks if not b.out]
    return [b for b in held if b.root] or [b for b in held if 2 * b.linked <= len(b.text)]


def host_of(url: Column) -> Column:
    """The host of an address in lower case, empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))),
                            r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return host


def structures(pages: DataFrame) -> DataFrame:
    """(host, row, elements, says, rooted, texts) of every page: the tokens of its elements
    in order, a hash of what its article says, whether that is in an article's element, and
    its distinct texts: token, slot, count, characters, those in links, root, beside."""
    lists = ["token", "slot", "count", "chars", "linked", "root", "beside"]
    kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, says, rooted = [], [], []
            texts: list[list] = [[] for _ in lists]
            for html in batch.column(2):
                nodes, blocks = read_page(html.as_py())
                elements.append([n.token for at, n in enumerate(nodes) if at and n.container == at])
                article = content(blocks)
                says.append(token(*(b.text for b in article)))
                rooted.append(any(b.root for b in article))
                seen: dict[int, list] = {}
                for b in blocks:
                    row = seen.setdefault(
                        text_token(b), [nodes[b.node].token, 0, 0, 0, b.root, b.out])
                    row[1] += 1
                    row[2] += len(b.text)
                    row[3] += b.linked
                texts[0].append(list(seen))
                for k in range(1, len(lists)):
                    texts[k].append([row[k - 1] for row in seen.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(elements, pa.list_(pa.int64())),
                 pa.array(says, pa.int64()), pa.array(rooted, pa.bool_()),
                 *[pa.array(values, pa.list_(kind)) for values, kind in zip(texts, kinds)]],
                ["host", "row", "elements", "says", "rooted", *lists])

    longs = ", ".join(f"{name} ARRAY<BIGINT>" for name in lists[:5])
    read = pages.select("host", "row", "html").mapInArrow(
        run, "host STRING, row STRING, elements ARRAY<BIGINT>, says BIGINT, rooted BOOLEAN,"
             f" {longs}, root ARRAY<BOOLEAN>, beside ARRAY<BOOLEAN>")
    return read.select("host", "row", "elements", "says", "rooted",
                       F.arrays_zip(*lists).alias("texts"))


def in_classes(structure: DataFrame, dealt: Dealt, elements: DataFrame) -> DataFrame:
    """(host, vector) of the valid classes among the elements (host, token, vector): those
    that come in one order and are nested on every page."""
    tokens = elements.groupBy("host").agg(F.collect_list("token").alias("tokens"),
                                          F.collect_list("vector").alias("vectors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # least and greatest order, whether two classes cross
        for batch in batches:
            for host, page, *known in zip(*(c.to_pylist() for c in batch.columns)):
                vector_of = dict(zip(*known))
                met = [(t, vector_of[t]) for t in page if t in vector_of]
                left = Counter(v for _, v in met)
                order: dict[int, int] = {}
                open_now: list[int] = []
                crossed: set[int] = set()
                for t, v in met:
                    if v in order:
                        while open_now[-1] != v:
                            other = open_now.pop()
                            if left[other]:
                                crossed.add(other)
                                order.pop(other)
                                crossed.add(v)
                    else:
                        open_now.append(v)
                    order[v] = token(str(order.get(v, 0)), str(t))
                    left[v] -= 1
                for v in left:
                    now = order.get(v, 0)
                    row = held.setdefault((host, v), [now, now, False])
                    row[:] = min(row[0], now), max(row[1], now), row[2] or v in crossed
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int64()),
             pa.array([r[0] for r in held.values()], pa.int64()),
             pa.array([r[1] for r in held.values()], pa.int64()),
             pa.array([r[2] for r in held.values()], pa.bool_())],
            ["host", "vector", "low", "high", "crossed"])

    parts = dealt.joined(structure.select("host", "row", "elements"), tokens, "inner").select(
        "host", "elements", "tokens", "vectors").mapInArrow(
        run, "host STRING, vector BIGINT, low BIGINT, high BIGINT, crossed BOOLEAN")
    return parts.groupBy("host", "vector").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.max("crossed").alias("crossed")).filter("low = high AND NOT crossed").select("host", "vector")


class Dealt:
    """Joins of pages with a row of their host, in which the pages of a host with more than
    one in HEAVY of all are dealt to several tasks.  There are fewer than HEAVY such hosts,
    so they are sent to all tasks."""

    def __init__(self, hosts: DataFrame):
        total = hosts.agg(F.sum("all_pages")).first()[0] or 0
        self.heavy = hosts.filter(F.col("all_pages") * HEAVY > total).select(
            "host", F.ceil(F.col("all_pages") * HEAVY / F.lit(max(total, 1))).alias("parts"))

    def joined(self, pages: DataFrame, rows: DataFrame, how: str) -> DataFrame:
        heavy, parts = F.broadcast(self.heavy), F.coalesce("parts", F.lit(1))
        left = pages.join(heavy, "host", "left").withColumn(
            "part", F.pmod(F.xxhash64("row"), parts)).drop("parts")
        right = rows.join(heavy, "host", "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
        return left.join(right, ["host", "part"], how).drop("part")


def most_fixed(contents: str, share: float, chance: int) -> str:
    """SQL: the share that a template's texts may have of what the pages say.  The more
    different contents agree on a text, the less does it need to be a small part of them."""
    return f"({share} * (1 - {chance} / {contents}))"


def templates(structure: DataFrame, hosts: DataFrame, dealt: Dealt) -> DataFrame:
    """(host, elements, slots, varieties, fixed) of every host: its template's elements, the
    slots that do not hold links mostly, with their variety, and the template's texts.

    ``fixed`` holds texts that are on every page as often as a valid class's elements."""
    elements = stored(structure.select("host", "row", F.explode("elements").alias("token")).groupBy(
        "host", "token").agg(F.bit_xor(F.xxhash64("row")).alias("vector"),
                             F.count(F.lit(1)).alias("n_pages")).filter("n_pages > 1"), "page-elements")
    valid = stored(in_classes(structure, dealt, elements), "page-classes")
    kept = elements.join(valid, ["host", "vector"], "left_semi").groupBy("host").agg(
        F.collect_list("token").alias("elements"))
    texts = stored(structure.select("host", "row", F.inline("texts")).filter("NOT beside").groupBy(
        "host", "token").agg(
        F.bit_xor(F.expr("IF(count = 1, xxhash64(row), xxhash64(row, count))")).alias("vector"),
        F.count(F.lit(1)).alias("n_pages"), F.sum("count").alias("times"), F.min("slot").alias("slot"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("root").alias("root")),
        "page-texts")
    slots = texts.groupBy("host", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.sum(F.expr("chars / times")).alias("distinct"), F.max("root").alias("root"))
    plain = slots.filter("2 * linked <= chars").groupBy("host").agg(
        F.collect_list("slot").alias("slots"),
        F.collect_list(F.expr("distinct / chars")).alias("varieties"))
    said = slots.groupBy("host").agg(
        F.sum(F.expr("IF(root, chars, 0)")).alias("in_article"),
        F.sum(F.expr("IF(NOT root AND 2 * linked <= chars, chars, 0)")).alias("outside"))
    fixed = texts.join(hosts, "host").filter("n_pages = all_pages AND contents > 1").join(
        valid, ["host", "vector"], "left_semi").groupBy("host").agg(
        F.collect_list(F.when(F.col("root"), F.col("token"))).alias("fixed_in"),
        F.collect_list(F.when(~F.col("root"), F.col("token"))).alias("fixed_out"),
        F.sum(F.expr("IF(root, chars, 0)")).alias("chars_in"),
        F.sum(F.expr("IF(NOT root AND 2 * linked <= chars, chars, 0)")).alias("chars_out"))
    none = F.expr("CAST(array() AS ARRAY<BIGINT>)")
    few_in = F.expr(
        f"chars_in <= {most_fixed('articles', FIXED_IN_ARTICLE, CHANCE_IN_ARTICLE)} * in_article")
    few_out = F.expr(f"chars_out <= {most_fixed('contents', FIXED_SHARE, CHANCE)} * outside")
    return hosts.join(kept, "host", "left").join(plain, "host", "left").join(
        said, "host", "left").join(fixed, "host", "left").select(
        "host", "elements", "slots", "varieties",
        F.concat(F.when(few_in, F.col("fixed_in")).otherwise(none),
                 F.when(few_out, F.col("fixed_out")).otherwise(none)).alias("fixed"))


def main_blocks(html: str | None, elements: set[int], variety: dict[int, float] | None,
                fixed: set[int]) -> list[str]:
    """The texts in the slots of a page's article.  ``variety`` holds the host's slots that
    are not links mostly; None for a page without a host."""
    nodes, blocks = read_page(html)
    held = [b for b in blocks if not b.out]
    if any(b.root for b in held):
        return [b.text for b in held if b.root and text_token(b) not in fixed]
    if variety is None:
        sums: dict[int, list[int]] = {}
        for b in held:
            row = sums.setdefault(nodes[b.node].token, [0, 0])
            row[0] += len(b.text)
            row[1] += b.linked
        variety = {t: 1.0 for t, (chars, linked) in sums.items() if 2 * linked <= chars}
    held = [b for b in held if nodes[b.node].token in variety and text_token(b) not in fixed]
    sizes = [0.0] * len(nodes)
    for b in held:
        sizes[b.node] += max(0, len(b.text) - b.linked) * variety[nodes[b.node].token]
    sizes = sums_above(nodes, sizes)
    template = {at for at, n in enumerate(nodes) if n.container == at and n.token in elements}
    steps = template or {at for at, n in enumerate(nodes) if n.container == at}
    # Children come after their parents; what is on the way has more than half of the text
    # of the element above it, so it is alone there.
    way, last = {0}, 0
    for at in range(1, len(nodes)):
        above = nodes[nodes[at].parent].container
        if above == last and at in steps and 2 * sizes[at] > sizes[last]:
            way.add(at)
            last = at
    within = [False] * len(nodes)
    for at, node in enumerate(nodes):
        within[at] = at == last or at > 0 and within[node.parent]
    return [b.text for b in held if within[b.node] or b.node in way]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """(key, url, host, blocks) of every page."""
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"),
        F.coalesce(F.col(key).cast("string"), F.xxhash64(html).cast("string")).alias("row"),
        F.col(html).alias("html"))
    structure = stored(structures(rows.filter("host <> ''")), "page-structures")
    hosts = stored(structure.groupBy("host", "says").agg(
        F.count(F.lit(1)).alias("n"), F.max("rooted").alias("rooted")).groupBy("host").agg(
        F.sum("n").alias("all_pages"), F.count(F.lit(1)).alias("contents"),
        F.greatest(F.count_if("rooted"), F.lit(1)).alias("articles")), "page-hosts")
    dealt = Dealt(hosts)
    known = stored(templates(structure, hosts, dealt), "page-templates")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = (batch.column(k).to_pylist() for k in (4, 5, 6, 7))
            texts = [main_blocks(value.as_py(), set(elements or ()),
                                 dict(zip(slots or (), varieties or ())) if host else None,
                                 set(fixed or ()))
                     for host, value, elements, slots, varieties, fixed in zip(
                         batch.column(2).to_pylist(), batch.column(3), *lists)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array(texts, pa.list_(pa.string()))], ["key", "url", "host", "blocks"])

    return dealt.joined(rows, known, "left").select(
        "key", "url", "host", "html", "elements", "slots", "varieties", "fixed").mapInArrow(
        run, f"key {kind}, url STRING, host STRING, blocks ARRAY<STRING>"
    ).withColumnRenamed("key", key)


def q_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join("blocks", "\n\n")
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "host")
