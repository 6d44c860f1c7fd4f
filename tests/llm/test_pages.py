"""Operator 5 on written pages and against a plain reading of the driver's pages."""

import re
from html import unescape

import pytest

from riskloom.llm.pages import Page, host_of, main_text, parse


def text_of(html):
    texts, _, named, *_ = Page(html).result()
    return " ".join("".join(t for t, n in zip(texts, named) if not n).split())


def test_driver_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in main_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:  # these pages hold one article of headings and paragraphs
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", inner)
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
        assert got[r.page_id].url == r.url


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain &amp; simple &lt;b&gt;", "plain & simple <b>"),
    ("<p>a<b>b</b>c<br>d<p>e", "abc d e"),
    ("<nav>menu</nav><p>text</p><footer>end</footer>", "text"),
    ("<div class='side-bar sidebar'>x</div><div id=cookieNotice>y</div><p>z</p>", "z"),
    ("<main><h1>T</h1><article><p>one</p></article></main><p>outside</p>", "T one"),
    ("<article><header><h1>Head</h1></header><p>body</p><div class=comments>c</div></article>",
     "Head body"),
    ("<article class=comment>c</article><article>kept</article>", "kept"),
    ("<p>if a < b and c > d</p>", "if a < b and c > d"),
    ("<script>var a='</p>';<p>no</p></script><p>yes</p>", "yes"),
    ("<style>p{}</style><!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
    ("<p title='a > b'>t</p><p title=\"x>y\">u", "t u"),
    ("<article><p>w&nbsp;x\n\t y</article></body></html>", "w x y"),
    ("<form><p>f</p></form><div role=navigation>n</div>t", "t"),
    ("<a href=\"unclosed>x</a><p>ok</p>", "x ok"),
])
def test_markup(html, want):
    assert text_of(html) == want


def test_hosts():
    assert host_of("HTTP://WWW.a.example:80/x?y#z") == "www.a.example"
    assert host_of("//b.example") == "b.example" and host_of(None) == "" and host_of("x/y") == ""


def test_templates(spark):
    share = "<div class=box><p>Read more on our site</p></div>"
    rows = [(i, f"http://h.example/{i}",
             f"<title>t{i}</title><article><h1>t{i}</h1><p>{'word%d ' % i * 30}</p>{share}"
             f"<p>The same closing words.</p></article>") for i in range(8)]
    # copies of one article under one heading are no template
    rows += [(100 + i, f"http://copy.example/{i}",
              "<title>same</title><article><div><p>first part</p></div><div><p>second part</p></div>"
              "<div><p>third part</p></div></article>") for i in range(20)]
    # too few pages of another host
    rows += [(200 + i, f"http://few.example/{i}",
              f"<title>f{i}</title><article><p>{'few%d ' % i * 30}</p>{share}</article>")
             for i in range(3)]
    rows += [(None, None, None), rows[0], (300, "http://h.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": pages_text(), "host": pages_text()}).repartition(3)
    got = main_text(pages).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    for i in range(8):
        assert texts[i] == f"t{i} " + f"word{i} " * 30 + "The same closing words."
    assert texts[100] == "first part second part third part"
    assert texts[200].endswith("Read more on our site")
    assert texts[None] == "" and texts[300] == ""


def test_pages_are_told_apart_by_their_content(spark):
    banner = ("<div class=top><div>Our site, since 1999, all about words and their many uses, "
              "and about all that is made of them.</div></div>")
    body = "<div class=text>%s</div>"
    same_title = [(i, "http://one.example/", f"<title>Site</title>{banner}"
                   + body % (f"left{i} " * 40)) for i in range(8)]
    untitled = [(20 + i, "http://none.example/", banner + body % (f"right{i} " * 40)) for i in range(8)]
    copies = [(40 + i, "http://copy.example/", f"<title>copy {i}</title>"
               "<div>first part</div><div>second part</div><div>third part</div>") for i in range(20)]
    texts = {r.page_id: r.text for r in main_text(spark.createDataFrame(
        same_title + untitled + copies, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert texts[i] == " ".join([f"left{i}"] * 40)
        assert texts[20 + i] == " ".join([f"right{i}"] * 40)
    assert texts[40] == "first part second part third part"


def test_templates_hold_a_share_of_the_host(spark):
    banner = "<div class=top><div>Our site, since 1999, all about words.</div></div>"
    rows = []
    for i in range(100):
        heading = "<h2>Introduction</h2>" if i < 30 else f"<h2>Part {i}</h2>"
        table = "<table><tr><td>He agreed to it.</td></tr></table>" if i % 15 == 0 else ""
        rows.append((i, "http://big.example/",
                     f"{banner}<div>{heading}<p>{f'left{i} ' * 40}</p>{table}</div>"))
    texts = {r.page_id: r.text for r in main_text(spark.createDataFrame(
        rows, "page_id long, url string, html string")).collect()}
    assert texts[1] == "Introduction " + " ".join(["left1"] * 40)
    assert texts[90] == "Part 90 " + " ".join(["left90"] * 40) + " He agreed to it."


def test_counts_decide_without_names(spark, sf):
    """Menus whose class says nothing, beside named ones, with the names switched off."""
    rows = []
    for i in range(40):
        menu = "<div class=x1><ul><li>Home</li><li>About us</li><li>All our pages</li></ul></div>"
        nav = "<nav><a>Start</a> <a>Contact</a></nav>"
        advert = f"<div class=ad>buy number {i}</div>"  # another one on every page
        rows.append((i, "http://menu.example/",
                     f"{nav}{menu}<div class=x2><p>{f'left{i} ' * 30}</p></div>{advert}"
                     "<div class=x3><div>Imprint</div><div>Terms of use</div></div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    body = {i: " ".join([f"left{i}"] * 30) for i in range(40)}
    bare = {r.page_id: r for r in main_text(pages, use_names=False).collect()}
    assert all(bare[i].text == f"{body[i]} buy number {i}" for i in body)
    assert all(r.n_template == len("Start Contact Home About us All our pages Imprint Terms of use")
               or r.n_template > 50 for r in bare.values())
    both = {r.page_id: r for r in main_text(pages).collect()}
    assert all(both[i].text == body[i] and both[i].n_named > 0 for i in body)
    parsed = parse(spark.read.parquet(f"{sf}/pages.parquet"))
    assert parsed.where("size(possible) > 0").count() > 0


def pages_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_nothing(spark, sf):
    assert main_text(spark.read.parquet(f"{sf}/pages.parquet").limit(0)).count() == 0


def test_markup_is_read_in_linear_time():
    import time

    start = time.time()
    for html in ("<a \"" * 50_000, "<div>" * 20_000, "<!--" * 50_000, "<p><b>" * 20_000, "&amp" * 9**5):
        Page(html).result()
    assert time.time() - start < 60
