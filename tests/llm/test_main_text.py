"""Operator 12: the parser on awkward markup, gradients against differences, pages against a plain reader of their article, held-out layouts."""

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from offerlens.llm import blocklabels
from offerlens.llm.blockpages import leaves

SF = "/root/testdata/sf0.01"


class Article(HTMLParser):
    """The text of the element <article>, by the parser of the standard library; for pages that all have one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] if tag in ("p", "h1", "article") else []

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] if tag in ("p", "h1", "article") else []

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def plain(page):
    reader = Article()
    reader.feed(page)
    reader.close()
    return "\n\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)


def test_leaves():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><script>var a="</p><p>no";</script><style>p{}</style></head><body><!-- <p>no</p> -->
    <nav><ul><li><a href="/x?a>b">A</a><li>B</ul></nav><article class="postBody main_x"><h1>He<b>ll</b>o</h1><p>one <a href='>'>two</a><p>three &nbsp;f<br>our &#xe9;&lt;
    <table><tr><td>x<td>y<tr><td>z</table><p>5 < 6 & 7</article><div style="display: none">hid</div><footer>&copy; me"""
    got = leaves(page)
    assert [x.text for x in got] == ["T & x", "A", "B", "Hello", "one two", "three f our é<", "x", "y", "z", "5 < 6 & 7", "hid", "© me"]
    assert got[4].path == (("html",), ("body",), ("article", "post", "body", "main", "x"), ("p",)) and got[4].linked == 3
    assert got[8].path[-3:] == (("table",), ("tr",), ("td",)) and got[10].path[-1] == ("div", "hidden")
    for odd in ("", " ", "<", "<>", "</", "a<b", "<!--", "<p", '<p class="', "<script>x", "<a b='" * 1000, "</p>" * 1000, "<div>" * 5000 + "x", "\x00&#0;&bogus;"):
        leaves(odd)
    assert [x.text for x in leaves('<p title="a>b>one<p>two')] == ["b>one", "two"]


def test_gradients():
    rng = np.random.default_rng(1)
    m = blocklabels.Labeller()
    pages, labels = [rng.normal(size=(n, blocklabels.DIMS)).astype(np.float32) for n in (1, 4, 6)], [np.array(y, np.float32) for y in ([1], [0, 1, 1, 0], [1, 0, 0, 1, 1, 0])]

    def loss():
        c = m.chances(pages)
        return -sum((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() for y, p in zip(labels, [x.astype(np.float64) for x in c])) / 11

    for w, g in zip(m.weights(), m.gradients(pages, labels)):
        at = tuple(rng.integers(0, n) for n in w.shape)
        before = w[at]
        w[at] = before + 1e-2
        up = loss()
        w[at] = before - 1e-2
        down = loss()
        w[at] = before
        assert abs((up - down) / 2e-2 - g[at]) < 2e-4


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


def test_against_plain(spark, pages):
    got = {r.page_id: r for r in blocklabels.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_held_out_layouts(pages):
    """Layouts drawn anew, from texts that were not learned from."""
    html = [r.html for r in pages.orderBy("page_id").collect()]
    m, rng = blocklabels.train(html[:120]), random.Random(99)
    texts = [x.text for h in html[120:] for p in [leaves(h)] for x, y in zip(p, blocklabels.taught(p)) if y]
    drawn = [blocklabels.layout(texts, rng) for _ in range(500)]
    got = np.concatenate(m.chances([blocklabels.vectors(p) for p, _ in drawn])) >= 0.5
    want = np.concatenate([np.array(y) for _, y in drawn]) == 1
    assert (got == want).mean() > 0.95
    assert (got & want).sum() / want.sum() > 0.94


def sentences(seed, n=14):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice(["river", "stone", "the", "cold", "of", "walked", "over", "evening", "quietly", "market"]) for _ in range(n)).capitalize() + "." for _ in range(2))


@pytest.mark.parametrize("open_article", ['<article class="post">', '<main id="content">', '<div class="main-content">', '<div id="main"><div class="entry-content">', '<section class="article-body">'])
def test_other_pages(spark, pages, open_article):
    """Pages written by hand, of other templates than the learned ones, with all that is not to be kept."""
    close = "".join(f"</{t.split(' ')[0].split('>')[0]}>" for t in reversed(open_article.split("<")[1:]))
    body = [sentences(i) for i in range(5)]
    page = f"""<html><head><title>A walk</title></head><body><div class="cookie-banner"><p>We use cookies to improve this site. Accept all</p></div>
    <header class="site-header"><div class="logo">The Daily</div><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav></header>
    {open_article}<h1>A walk over stone</h1><p>{body[0]}</p><p>{body[1]}</p><div class="ad">Buy now, sponsored offer.</div><h2>The market</h2><p>{body[2]}</p><ul><li>{body[3]}</li><li>{body[4]}</li></ul>{close}
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/a">Ten stones</a></li><li><a href="/b">Cold rivers</a></li></ul></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>{sentences(9)}</p></div><div class="comment"><p>{sentences(8)}</p></div></section>
    <form class="newsletter"><label>Subscribe to our newsletter</label><input><button>Sign up</button></form><footer><p>Copyright The Daily</p></footer></body></html>"""
    rows = spark.createDataFrame([(-1, None, page), (-2, "u", None), (-3, "u", ""), (None, "u", page), (-4, "u", "<p>"), (-5, "u", f"<body><article><h1>Long</h1>{f'<p>{body[0]}</p>' * 4000}</article>")], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(rows).selectExpr("*", "1 AS text", "'x' AS n_chars")
    got = {r.page_id: r for r in blocklabels.extract(both).where("page_id < 0 OR page_id IS NULL").collect()}
    want = "\n\n".join(["A walk over stone", body[0], body[1], "The market", *body[2:]])
    assert got[-1].text == want and got[None].text == want and got[-1].url is None
    assert (got[-2].text, got[-2].n_chars, got[-3].text, got[-4].text) == ("", 0, "", "")
    assert got[-5].text == "\n\n".join(["Long", *[body[0]] * 4000])


def test_empty(spark, pages):
    assert blocklabels.extract(pages.limit(0)).count() == 0
