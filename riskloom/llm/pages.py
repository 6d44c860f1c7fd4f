"""Operator 5, main text of web pages with site templates removed.

Every page is parsed once. Where it has an ``article`` or ``main`` element, the text inside it is the
candidate, otherwise the whole body. All element subtrees (tag, text and child hashes) are hashed, menus
and adverts among them, the different pages of a host that hold a subtree are counted in Spark, and subtrees
on a share of them are deleted. What differs from page to page cannot be found by counting: of that, elements
which the markup itself names as menu, header, footer, sidebar, notice, advert, form or reader comments go
too (``use_names``). ``n_template`` and ``n_named`` say how many characters each of the two took away.

Copies of one article on a host are not a template: pages are told apart by what they hold besides the
subtree, so a subtree counts once per remaining content, and subtrees that hold half of a page's text or
more, and plain text blocks inside an article, are never candidates. Counting is a partial aggregate on
(host, subtree, remaining content), so a host with a third of all pages is spread over its subtrees; only
pages with candidates travel to their deletions.

Defined cases: a null or empty html gives an empty text; a null url is the host without a name; a null
``page_id`` stays null; repeated rows give repeated rows; extra columns are ignored. Unclosed elements
end with their parent or where HTML lets them end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.tables import keep
from riskloom.llm.words import arrow_schema

#: Different pages from which on a subtree is a template of its host.
PAGES = 5
#: Share of the host's different pages that it must stand on besides, and that of a text block (a heading,
#: paragraph, list item or cell outside an article), which is content on fewer.
SHARE, BLOCK_SHARE = 0.1, 0.5

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"""
    r"""(?P<attrs>(?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?][^<>]*+>""", re.S)
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+").findall
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
# What is not the article, by element, by role and by a word of class or id.
HIDDEN = frozenset(
    "head script style noscript template iframe svg math button select textarea object canvas audio "
    "video title".split())
NOT_TEXT = frozenset("nav header footer aside form dialog menu".split())
NOT_TEXT_ROLE = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
NOT_TEXT_NAME = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside "
    "comment comments disqus cookie cookies consent gdpr notice notices menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead banner".split())
REGION = frozenset({"article", "main"})
TEXT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead blockquote pre figcaption caption hr".split())


class Element:
    __slots__ = ("tag", "hidden", "named", "region", "number", "items", "size", "holds")

    def __init__(self, tag: str, hidden: bool, named: bool, region: bool, number: int):
        self.tag, self.hidden, self.named = tag, hidden, named
        self.region, self.number = region, number
        self.items: list[str] = []  # texts and child hashes, for the subtree's hash
        self.size = 0  # characters of text
        self.holds = False  # a region below


def names(attrs: str) -> tuple[str, str, str]:
    """class, id and role in lower and original case, empty where absent."""
    found = {"class": "", "id": "", "role": ""}
    for key, *values in ATTR.findall(attrs):
        found[key.lower()] = next((v for v in values if v), "")
    return found["class"], found["id"], found["role"].lower()


class Page:
    """One pass over the markup of a page."""

    def __init__(self, html: str):
        from xxhash import xxh64_intdigest

        self.hash = xxh64_intdigest
        self.stack: list[Element] = [Element("", False, False, False, 0)]
        self.done: dict[int, tuple] = {}  # number -> hash, size, tag, holds a region, in a region, named
        self.texts: list[list] = []  # pieces of text, innermost element, in a region, named
        self.open: Counter[str] = Counter()
        self.parent = [0]  # of each element's number
        self.regions = 0
        self.read(html)
        while len(self.stack) > 1:
            self.close()

    def read(self, html: str) -> None:
        at = 0
        while True:
            m = TAG.search(html, at)
            self.text(html[at:m.start() if m else len(html)])
            if not m:
                return
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                self.end(tag)
                continue
            self.start(tag, m["attrs"])
            if tag in RAW and not m["attrs"].endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
                self.close()

    def start(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self.close_to({"p"}, {"td", "th", "div", "section", "article", "body", "li", "table"})
        if tag in SAME_LEVEL:
            self.close_to(*SAME_LEVEL[tag])
        if tag not in INLINE:
            self.space()
        if tag in VOID:
            return
        top = self.stack[-1]
        named = top.named
        if not named and tag not in ("html", "body"):
            cls, ident, role = names(attrs) if attrs else ("", "", "")
            inside = self.open["article"] > 0
            named = (tag in NOT_TEXT and not (tag == "header" and inside)) \
                or role in NOT_TEXT_ROLE \
                or any(p.lower() in NOT_TEXT_NAME
                       and not (inside and p.lower() == "header")
                       for p in NAME_PARTS(f"{cls} {ident}"))
        region = top.region or (tag in REGION and not named)
        element = Element(tag, top.hidden or tag in HIDDEN, named, region, len(self.parent))
        self.parent.append(top.number)
        self.open[tag] += 1
        if region and not top.region:
            self.regions += 1
            for e in self.stack:
                e.holds = True
            element.holds = True
        self.stack.append(element)

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.space()
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self.close()
            self.close()

    def close_to(self, tags: set[str], limit: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``limit`` is in between."""
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag in tags:
                while len(self.stack) > depth:
                    self.close()
                return
            if self.stack[depth].tag in limit:
                return

    def close(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if e.hidden:
            return
        parent = self.stack[-1]
        value = self.hash("\x1f".join([e.tag, *e.items]))
        if parent.named or not e.named:  # what surrounds an advert is the same with any
            parent.items.append(f"{value:x}")
            parent.size += e.size
        self.done[e.number] = (value, e.size, e.tag, e.holds, parent.region, e.named)

    def space(self) -> None:
        if self.texts:
            self.texts[-1][0].append(" ")

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if not text or top.hidden:
            return
        if "&" in text:
            text = unescape(text)
        if self.texts and self.texts[-1][1] == top.number:
            self.texts[-1][0].append(text)
        else:
            self.texts.append([[text], top.number, top.region, top.named])
        flat = " ".join(text.split())
        if flat:
            top.items.append(flat)
            top.size += len(flat)

    def result(self) -> tuple[list[str], list[list[int]], list[bool], dict[int, tuple[int, bool]], int]:
        """Texts in page order, the hashes of the possible templates around each, whether its element is
        named, for each possible template of the page the hash of the page's texts outside it and whether
        it is a text block, and the hash of all texts that are not named."""
        texts = [("".join(t), n, named) for t, n, region, named in self.texts
                 if region or not self.regions]
        total = sum(len(" ".join(t.split())) for t, _, named in texts if not named)
        possible = {
            number: value - (1 << 64) if value >> 63 else value
            for number, (value, size, tag, holds, region, named) in self.done.items()
            if size and not holds and tag not in INLINE and tag not in ("html", "body")
            and (named or 2 * size < total or (self.regions and not region))
            and not (region and not named and tag in TEXT_BLOCKS)}
        chain: dict[int, list[int]] = {0: []}
        for number, up in enumerate(self.parent[1:], 1):  # parents come first
            chain[number] = chain[up] + [possible[number]] if number in possible else chain[up]
        out: list[tuple[list[str], list[int], bool]] = []
        for text, number, named in texts:
            if out and out[-1][1:] == (chain[number], named):
                out[-1][0].append(text)
            else:
                out.append(([text], chain[number], named))
        whole, inside = 0, dict.fromkeys(possible.values(), 0)
        for text, around, named in out:
            flat = " ".join("".join(text).split())
            if flat and not named:
                value = self.hash(flat)
                whole += value
                for h in set(around):
                    inside[h] += value
        block = {possible[n]: self.done[n][2] in TEXT_BLOCKS for n in possible}
        rest = {h: (signed(whole - v), block[h]) for h, v in inside.items()}
        return ["".join(t) for t, *_ in out], [a for _, a, _ in out], [n for *_, n in out], rest, \
            signed(whole)


def signed(value: int) -> int:
    """The low 64 bits as a signed number."""
    return (value + (1 << 63)) % (1 << 64) - (1 << 63)


PARSED = ("page_id long, url string, host string, whole long, texts array<string>, "
          "around array<array<bigint>>, named array<boolean>, "
          "possible array<struct<subtree: bigint, rest: bigint, block: boolean>>, row long")


def parse(pages: DataFrame) -> DataFrame:
    """Candidate texts of every page; ``possible`` are the distinct subtrees of the page that may be
    templates, outside its article too."""
    schema = T.StructType.fromDDL(PARSED)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html, row in zip(*(c.to_pylist() for c in batch.columns)):
                texts, around, named, rest, whole = Page(html or "").result()
                rows.append((page_id, url, host_of(url), whole, texts, around, named, [
                    {"subtree": h, "rest": r, "block": b} for h, (r, b) in sorted(rest.items())], row))
            columns = list(zip(*rows)) if rows else [[]] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def template_subtrees(parsed: DataFrame, pages: int) -> DataFrame:
    """``host`` and ``subtree`` of everything that stands on at least ``pages`` different pages of a host
    and on its share of them; pages that differ in the subtree alone are one."""
    own = (parsed.select("host", F.explode("possible").alias("p"))
           .select("host", "p.subtree", "p.rest", "p.block").distinct()
           .groupBy("host", "subtree").agg(F.count("*").alias("n"), F.max("block").alias("block"))
           .where(F.col("n") >= pages))
    sizes = parsed.select("host", "whole").distinct().groupBy("host").agg(F.count("*").alias("of"))
    share = F.when(F.col("block"), BLOCK_SHARE).otherwise(SHARE)
    return (own.join(sizes, "host").where(F.col("n") >= share * F.col("of"))
            .select("host", "subtree"))


def _joined(texts: list[str]) -> str:
    return " ".join(w for t in texts for w in t.split())


def main_text(pages: DataFrame, template_pages: int = PAGES, use_names: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page, and the characters that templates
    (``n_template``) and names alone (``n_named``) took from its article."""
    schema = T.StructType.fromDDL("page_id long, url string, text string, n_chars long, "
                                  "n_template long, n_named long")
    target = arrow_schema(schema)

    def size(texts: list[str]) -> int:
        return sum(len(" ".join(t.split())) for t in texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, texts, around, named, gone in zip(
                    *(c.to_pylist() for c in batch.columns)):
                gone = set(gone or ())
                stays = [gone.isdisjoint(a) for a in around]
                drop = [use_names and n for n in named]
                left = [t for t, s, d in zip(texts, stays, drop) if s and not d]
                text = _joined(left) if gone else " ".join("".join(left).split())
                rows.append((page_id, url, text, len(text),
                             size([t for t, s in zip(texts, stays) if not s]),
                             size([t for t, s, d in zip(texts, stays, drop) if s and d])))
            columns = list(zip(*rows)) if rows else [[]] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    parsed = keep(parse(pages))
    inner = F.exists("around", lambda a: F.size(a) > 0)  # a subtree of the article may be one
    checked = parsed.where(inner)
    templates = template_subtrees(parsed, template_pages)
    gone = (checked.select("row", "host", F.explode(F.array_distinct(F.flatten("around")))
                           .alias("subtree"))
            .join(templates, ["host", "subtree"], "left_semi")
            .groupBy("row").agg(F.collect_set("subtree").alias("gone")))
    columns = ["page_id", "url", "texts", "around", "named"]
    free = parsed.where(~inner).select(
        *columns, F.lit(None).cast("array<bigint>").alias("gone"))
    return (checked.join(gone, "row", "left").select(*columns, "gone").unionByName(free)
            .mapInArrow(run, schema))
