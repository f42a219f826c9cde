"""Main text of pages with known content."""

import re

import pytest

from quarte.llm import html
from quarte.llm.html import Page, host_of

SCHEMA = "page_id long, url string, html string, path string, host string"
FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="sidebar">Side</div><div class="post-12 hentry"><article><header><h1>Title &amp; more</h1><p>By A</p></header>
<p>First&nbsp;par <b>bold</b>,<br>next  line.<p>Second &lt;x&gt; par&#233;.</p><div class="ad">Buy now</div><ul><li>one<li>two</ul>
<!-- <p>hidden</p> --><form>Subscribe <input></form><table><tr><td>c1<td>c2</table></article></div>
<section id="comments"><p>Nice article, long comment text here that goes on and on.</p></section></div><aside>x</aside>
<footer>&copy; site</footer>"""
WANT = "Title & more\nFirst par bold, next line.\nSecond <x> paré.\none\ntwo\nc1\nc2"


def test_full_page():
    assert Page(FULL).text(None) == WANT


@pytest.mark.parametrize("text", ["", "plain", "a < b > c", "<", "<p", "<!--", "<script>x", "</p></div>", "<p><b>x<br><p>y", "<div " + "a" * 9000,
                                  "<div>" * 3000 + "deep" + "</div>" * 3000, "<a href='" + "x" * 5000])
def test_odd_pages_do_not_fail(text):
    Page(text).text(None)
    Page(text).text("body")


@pytest.mark.parametrize("part", ["<b>", "<a ", "<p>", "<li>", "<", "<div class='x'>", "<a href=\"", "</div>", "<!-- x "])
def test_long_odd_pages_take_time_in_proportion(part):
    import time

    began = time.process_time()
    Page(part * 20000 + "end").text(None)
    assert time.process_time() - began < 10


def test_unclosed_comment_goes():
    assert Page("<p>one</p>two<!-- three").text(None) == "one\ntwo"


def test_unclosed_and_entities():
    page = "<html><body><nav>menu</nav><article><h1>H</h1><p><b>One.<br><p>Two &amp; &eacute;</article><footer>f</footer>"
    assert Page(page).text(None) == "H\nOne.\nTwo & é"


def test_hosts():
    urls = ["http://A.example.org/x", "https://u@b.org:80/", "//c.net/a", "bad", None, ""]
    assert [host_of(u) for u in urls] == ["a.example.org", "b.org", "c.net", "", "", ""]


def test_consensus_over_a_host(spark):
    """A page whose boilerplate is longer than its text is read where its host's other pages have theirs."""
    say = "Some running text of the page that is long enough to count. "
    page = lambda text, other: f"<body><div class='x1'><p>{other}</p></div><div class='body2'><p>{text}</p></div></body>"
    rows = [(i, "http://h.org/%d" % i, page(say * 5 + str(i), "Other.")) for i in range(8)]
    rows += [(20, "http://h.org/s", page("Short.", say * 4)), (21, "http://other.org/", page("Short.", say * 4))]
    rows += [(30, None, None), (31, "http://h.org/e", ""), (32, "http://h.org/n", "<p>No div here</p>"), (None, "http://h.org/q", rows[0][2])]
    rows += [rows[1]]
    df = spark.createDataFrame([(*r, "p", "h") for r in rows], SCHEMA).repartition(3)
    got = html.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    text = {r.page_id: r.text for r in got.collect()}
    assert text[20] == "Short." and text[21] == (say * 4).strip() and text[3] == say * 5 + "3" and text[None] == say * 5 + "0"
    assert text[30] == text[31] == "" and text[32] == "No div here"
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_article_of_the_tables(spark):
    """On the given pages the text is the article's blocks, as a plain pattern reads them."""
    import re
    from html import unescape

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_empty_table(spark):
    assert html.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "with-sidebar", "no-comments", "comments-open"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_named_by_what_is_beside_keep_the_text(name, inner):
    body = f"<{inner}><p>The first paragraph of the page, long enough.</p><p>And a second one.</p></{inner}>"
    side = '<div class="sidebar"><p>Other pages</p></div><div id="comments"><article class="comment"><p>Nice one!</p></article></div>'
    html = f'<body><form id="f"><div class="{name}"><div id="{name}-2">{body}</div>{side}</div></form></body>'
    want = "The first paragraph of the page, long enough.\nAnd a second one."
    assert Page(html).text(None) == want or inner == "div"
    assert want in Page(html).text(None) and "Other pages" not in Page(html).text(None)


def test_an_advert_longer_than_the_article_stays_out():
    html = '<body><div class="ad">A rather long advert for something.</div><div class="sidebar"><article><p>Short.</p></article></div></body>'
    assert Page(html).text(None) == "Short."


@pytest.mark.parametrize("inside", [
    '<p>Run <span class="hljs-comment"># set it up</span> first.</p>', '<pre><code><span class="token comment">// a comment</span></code></pre>',
    '<h2 class="related-work">Related work</h2>', '<div class="social-history">A history of society.</div>', '<p>See <a class="share-price">the price</a>.</p>',
    '<p class="search-engine-history">Before the web.</p>', "<p>So <math><mi>x</mi> = 1</math> holds.</p>", "<p><object>Shown without a viewer</object></p>",
    "<xmp>a < b & c</xmp>", '<ul class="links"><li class="widget">A thing</li></ul>',
])
def test_names_inside_an_article_leave_text_alone(inside):
    shown = " ".join(re.sub("</?[a-z][^>]*>", "", inside).split())
    page = f"<body><article><p>The first paragraph.</p>{inside}<p>The last one.</p></article></body>"
    assert Page(page).text(None) == f"The first paragraph.\n{shown}\nThe last one."


@pytest.mark.parametrize("name", ["share-buttons", "related-posts", "comments-area", "newsletter-signup", "ad-container", "ad", "adSlot", "social", "post-comments"])
def test_blocks_of_such_words_stay_out_of_the_article(name):
    page = f'<body><article><p>The first paragraph.</p><div class="{name}"><p>Not this.</p></div><p>The last one.</p></article></body>'
    assert Page(page).text(None) == "The first paragraph.\nThe last one."


def test_hosts_whose_paths_tie_give_one_answer(spark):
    """Two templates with as many votes each: whichever wins, all rows of the same page give the same text, in any order."""
    say = "Some running text of the page that is long enough to count. "
    page = lambda name, other: f"<body><div class='{name}'><p>{say * 3}</p></div><div class='{other}'><p>{say}</p></div></body>"
    rows = [(1, "http://h.org/1", page("first", "second")), (2, "http://h.org/2", page("second", "first"))] * 3
    found = set()
    for parts in (1, 3, 5):
        df = spark.createDataFrame([(*r, "p", "h") for r in rows], SCHEMA).repartition(parts)
        texts = {(r.page_id, r.text) for r in html.main_text(df).collect()}
        assert len(texts) == 2
        found.add(frozenset(texts))
    assert len(found) == 1
