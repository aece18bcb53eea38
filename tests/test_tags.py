"""Landing-page evidence against the standard parser and address resolver."""

import html
import json
import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from scriptorium.operators import tags


class Plain(HTMLParser):
    """One page, tag by tag."""

    def __init__(self, url):
        super().__init__(convert_charrefs=True)
        self.url, self.base, self.meta, self.links, self.pdfs, self.data, self.shown, self.depth, self.raw, self.block = url, None, [], [], [], [], [], 0, None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in tags.VOID:
            if self.depth:
                self.depth += 1
            elif tag in tags.CONTAINERS and re.search(tags.ABSTRACT, " ".join(a.get(k, "") for k in ("id", "class", "data-title")).strip()):
                self.depth = 1
        self.shown += [" "] * bool(self.depth and tag in ("br", "p", "div", "section"))
        if tag == "base" and self.base is None and "href" in a:
            self.base = urljoin(self.url, a["href"])
        name = (a.get("name") or a.get("property") or "").lower()
        if tag == "meta" and name:
            self.meta.append((name, a.get("content", "")))
        if tag == "a" and "href" in a:
            self.links.append(a["href"])
        if tag == "meta" and name in tags.PDF_NAMES and "content" in a:
            self.pdfs.append(a["content"])
        if tag == "link" and a.get("type", "").lower() == "application/pdf" and "href" in a:
            self.pdfs.append(a["href"])
        if tag in ("script", "style", "title", "textarea"):
            self.raw, self.block = (tag, a.get("type", "").lower()), []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in tags.VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.raw:
            self.block.append(data)
        elif self.depth:
            self.shown.append(data)

    def handle_endtag(self, tag):
        self.shown += [" "] * bool(self.depth > 1 and tag in ("p", "div", "section", "li"))
        self.depth -= self.depth > 0
        if self.raw and self.raw[0] == tag:
            if self.raw == ("script", "application/ld+json"):
                try:
                    self.data.append(json.loads("".join(self.block)))
                except ValueError:
                    pass
            self.raw = None


def plain(url, page):
    p = Plain(url)
    p.feed(page)
    p.close()
    http = lambda refs: [u for r in refs if r and re.match("https?://[^/?#]", u := urljoin(p.base or url, r.strip()), re.I)]
    return p.base or url, p.meta, http(p.links), http(p.pdfs), p.data, re.sub(r"\s+", " ", "".join(p.shown)).strip()


PARTS = ["<p>", "</p>", "<div class='x'>", "<div class='Abstract main'>", "</div>", "<section id=Abs1>", "<section id=Abs12>", "</section>", "<br>", "<br/>", "words &amp; more ", "a < b ", "été &#233;&#xE9; ", "&copy; &nosuch; & ", "<!-- <a href='/no'> abstract -->",
    '<meta name="citation_pdf_url" content="/a.pdf?x=1&amp;y=2">', "<META NAME=DC.Title CONTENT='One > two'>", '<meta property="og:title" content="T">', '<meta name="DC.title" content="again">', '<link type="application/pdf" href="b.pdf">', "<link rel=next href=n.html>",
    "<a href='../up/./x.html#part'>up</a>", '<a title="x>y" href=//other.example/q>', "<a href='mailto:a@b.c'>m</a>", "<a>", '<a href="?page=2">', "<a href='ftp://x.example/'>", '<script type="application/ld+json">{"a": "<p>&amp;"}</script>', '<script type="application/ld+json">{no</script>', '<script>var t = "</p><a href=1>";</script>', "<style>p{}</style>", "<p data-title=abstract>", "<p class=abstract />", "<img alt=abstract src=i.png>"]


def test_evidence_and_abstracts_equal_the_standard_parser(spark):
    rng = random.Random(5)
    pages = {i: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for i in range(300)}
    pages = {i: ('<base href="https://b.example/d/e">' if i % 5 == 0 else "") + p for i, p in pages.items()}
    url = "http://host.example/dir/page.html?q=1#top"
    df = spark.createDataFrame([(i, url, p, "kept") for i, p in pages.items()], "page_id long, url string, html string, title string").repartition(4)
    got = {r.page_id: r for r in tags.evidence(df, "page_id", "url", "html").collect()}
    shown = {r.page_id: r.abstract for r in tags.abstracts(df, "page_id", "html").collect()}
    for i, page in pages.items():
        base, meta, links, pdfs, data, abstract = plain(url, page)
        r = got[i]
        assert (r.base, [tuple(m) for m in r.meta], r.links, r.pdfs) == (base, meta, links, pdfs), page
        assert [json.loads(d) for d in r.data] == data and shown.get(i, "") == abstract, page
    assert sum(len(r.pdfs) for r in got.values()) > 100 and len(shown) > 100


def test_references_equal_the_standard_resolver(spark):
    bases = ["http://h.example", "http://h.example/", "https://h.example/a/b/c?q=1", "http://h.example/a/../b/", "http://h.example/a/b?x=/y/z"]
    refs = ["x", "/x", "./x", "../x", "../../../x", "?y", "x/..", "..", ".", "#f", "", "//o.example/p/../q", "https://z.example/a/../b", "mailto:a@b", "x//y", "/a/./b/../c/", "é b", "a:b", " /t \n"]
    rows = [(b, r) for b in bases for r in refs]
    got = spark.createDataFrame(rows, "b string, r string").transform(lambda t: tags.resolve(t, "b", "r", "u")).collect()
    same = lambda u: re.sub("x/+y", "x//y", u)  # the standard library drops empty segments
    assert {(x.b, x.r): x.u for x in got} == {(b, r): same(urljoin(b, r.strip())) for b, r in rows}


def test_character_references(spark):
    texts = ["a &amp; b", "&lt;&gt;&quot;&#39;&apos;", "&#x1F600;&#128512;", "&#0;&#xD800;&#x110000;", "x & y && z &", "&nosuch; &#; &#x;", "&eacute;t&eacute; &nbsp;.", "&#233 end", "&#99999999999999999999;", "&amp;amp;", "", "plain", "&#00000000065;"]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(tags.unescaped(F.col("t"))).collect()
    assert [r[0] for r in got] == [html.unescape(t) for t in texts]


def test_odd_pages(spark):
    rows = [(1, None, None), (2, None, "<a href='/x'><a href='http://e.example/'><title> A\n&amp; B </title>"), (3, "http://h.example/p", ""), (4, "http://h.example/p", "<p title='" + "x" * 200_000), (5, "http://h.example/p", "<div class=abstract>" + "<p>w" * 20_000), (6, "no address", "<a href=x><title></title>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in tags.evidence(df, "page_id", "url", "html").collect()}
    assert got[1].title is None and got[1].meta == got[1].links == got[1].pdfs == got[1].data == [] and got[3].links == [] and got[6].links == []
    assert got[2].title == "A & B" and got[2].links == ["http://e.example/"] and got[2].base is None and got[6].title == ""
    assert [(r.page_id, r.k, r.link) for r in tags.links(df, "page_id", "url", "html").collect()] == [(2, 0, "http://e.example/")]
    shown = {r.page_id: r.abstract for r in tags.abstracts(df, "page_id", "html").collect()}
    assert shown == {5: " ".join(["w"] * 20_000)}
    assert tags.evidence(df.limit(0), "page_id", "url", "html").count() == tags.abstracts(df.limit(0), "page_id", "html").count() == 0
