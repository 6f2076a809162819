import html as escaping
import re

import pytest

from quotemill.llm import html_extract
from quotemill.llm.queries import QUERIES


def test_whole_query_gives_the_articles(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extraction"](spark, small).collect()
    assert len(rows) == len(pages)
    for row in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        parts = re.split(r"</?p>|</?h1>", re.sub("<br>", " ", inside))
        texts = [" ".join(escaping.unescape(re.sub("<[^>]*>", "", p)).split()) for p in parts]
        assert row.text == "\n\n".join(t for t in texts if t)
        assert row.n_chars == len(row.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p > a {}</style></head><body class="home">
<header><h2>Site</h2></header><div id="top" class="site-menu"><a href=/>menu</a></div><div class="layout">
<div class="post-{n}"><h1>Title &amp; more</h1><p>One<br>two &nbsp; three<p>Four <b>five</b>, <a href="x">six</a>.
<ul><li>seven<li>eight</ul><form><p>form</p></form><div class="ad">buy</div><!-- <p>no</p> -->
<script>if (a < b) document.write("</p><p>no</p>")</script><table><tr><td>a<td>b<tr><td>c</table>
<div id="comments"><p>a reader says a lot, really a lot, more than the text itself, again and again</p></div></div>
<div class="sidebar"><p>side</p></div><aside>aside</aside><div role="navigation">nav</div><div hidden>h</div>
<div style="display: none">x</div></div><footer>foot"""
TEXT = "Title & more\n\nOne two three\n\nFour five, six.\n\nseven\n\neight\n\na b\n\nc"


def main_text(html, path=None):
    return html_extract.main_text(html_extract.parse(html), path)


def best_path(html):
    return html_extract.best_path(html_extract.parse(html))[0]


def test_blocks_without_boilerplate():
    assert main_text(PAGE, None) == TEXT
    assert best_path(PAGE) == "html > body.home > div.layout > div.post-{n}"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<", "<"), ("a < b & c", "a < b & c"), ("<p>x", "x"), ("x</p></div>y", "xy"),
        ("<p>&#233;&eacute;&amp;amp;</p>", "éé&amp;"), ("<p>a</p><script>b", "a"), ("<p>a</p><!-- b", "a"), ("<p>a</p><div class='", "a"),
        ("<p title='>'>a</p>", "a"), ("<nav>n</nav>", ""), ("<p>one\n\t two</p>", "one two"), ("<P>UP</P><BR/>z", "UP\n\nz"),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html, None) == text


def test_host_consensus_overrules_a_page(make):
    usual = "<body><div class='c1'><p>{}</p></div><div class='x'><p>teaser</p></div></body>"
    odd = "<body><div class='c2'><p>short</p></div><div class='x'><p>a teaser that is much longer than the article itself, much longer</p></div></body>"
    rows = [(i, "http://h.test/a", usual.format("article text " * 20), "k", 1) for i in range(5)]
    rows += [(9, "http://h.test/b", odd, "k", 1), (10, "http://other.test/b", "<body><section><p>alone</p></section>", "k", 1)]
    rows += [(11, None, "<p>no host</p>", "k", 1), (12, "http://h.test", None, "k", 1), (None, "x", "", "k", 1), (10, "http://other.test/b", None, "k", 1)]
    rows += [(13, "http://h.test/c", usual.format("word " * 200_000), "k", 1)]
    df = make(rows, "page_id long, url string, html string, path string, host int")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    found = {(r.page_id, len(r.text) > 0): r.text for r in got}
    assert found[9, True] == "short" and found[10, True] == "alone" and found[11, True] == "no host"
    assert found[12, False] == "" and found[13, True] == ("word " * 200_000).strip()
    parsed = html_extract.parsed(df.select("page_id", "url", html_extract.host_of(df.url).alias("host"), "html"))
    winners = {r.host: r.path for r in html_extract.winning_paths(parsed, html_extract.repeated_blocks(parsed)).collect()}
    assert winners["h.test"] == "body > div.c0"


def test_empty_table(spark):
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


BODY = "the text of the article goes on and on " * 20
POST = "<div class='post'><h1>Title</h1><p>the lead</p><div class='post-body'><p>" + BODY + "</p></div><p>the closing line</p></div>"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<html><body>" + POST + "</body></html>", f"Title\n\nthe lead\n\n{BODY}\n\nthe closing line"),
        ("<body><article><p>first</p><div><div><p>" + BODY * 5 + "</p></div></div></article>", f"first\n\n{BODY * 5}"),
        ("<body><h1>Title</h1><div class='text'><p>" + BODY + "</p></div>", f"Title\n\n{BODY}"),
        ("<body><div class='title'><h1>Title</h1></div><div class='text'><p>" + BODY + "</p></div>", f"Title\n\n{BODY}"),
        ("<body><div class='post'><h1>Title</h1><article><p>" + BODY + "</p></article></div>", f"Title\n\n{BODY}"),
        ("<body><div><div class='in'><p>" + BODY + "</p></div><ul><li><a href=x>a link</a></ul></div>", BODY),
        ("<p>lead</p><div><p>" + BODY + "</p></div>", f"lead\n\n{BODY}"),
    ],
)
def test_a_step_inwards_loses_no_text(html, text):
    wanted = "\n\n".join(" ".join(part.split()) for part in text.split("\n\n"))
    assert main_text(html, best_path(html)) == wanted


@pytest.mark.parametrize(
    "opening",
    [
        "<div class='content has-sidebar'>", "<article class='post comments-open'>", "<div id='content' class='no-sidebar'>",
        "<div class='entry share-enabled'>", "<form action='/page.aspx'>", "<div class='sidebar-layout'>", "<section class='page with-ads'>",
    ],
)
def test_unwanted_names_on_the_content_itself(opening):
    tag = re.match("<([a-z]+)", opening)[1]
    html = f"<body><div>{opening}<h1>Title</h1><p>{BODY}</p><div class='sidebar'><p>side</p></div><div id='comments'>a reader</div></{tag}></div><p>end</p>"
    for path in (None, "", best_path(html)):
        text = main_text(html, path)
        assert text.startswith("Title\n\nthe text") and "side" not in text and "reader" not in text


def test_names_and_forms_still_hide_what_is_beside_the_text():
    for box in ("<div class='sidebar'>", "<form>", "<div class='related-posts'>", "<div class='post-comments'>", "<div id='comments'>"):
        html = f"<body><div class='x'><p>{BODY}</p></div>{box}<p>{'hidden ' * 100}</p></{'form' if 'form' in box else 'div'}>"
        assert "hidden" not in main_text(html, None)


PARAGRAPHS = "".join(f"<p>Paragraph {i} of the article, which says a lot.</p>" for i in range(12))
WHOLE = "\n\n".join(f"Paragraph {i} of the article, which says a lot." for i in range(12))


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><p>lead</p><article>" + PARAGRAPHS + "</article>", f"lead\n\n{WHOLE}"),
        ("<body><div class=lead>lead</div><div class=post>" + PARAGRAPHS + "</div>", f"lead\n\n{WHOLE}"),
        ("<body><div class=post>" + PARAGRAPHS + "</div><div class=end>end</div>", f"{WHOLE}\n\nend"),
        ("<body><section class=a>" + PARAGRAPHS + "</section><section class=b>end</section>", f"{WHOLE}\n\nend"),
        ("<body><article>" + PARAGRAPHS + "<p class=share>We share what we know.</p></article>", f"{WHOLE}\n\nWe share what we know."),
        ("<body><article>" + PARAGRAPHS + "<section id=search><p>The search went on.</p></section></article>", f"{WHOLE}\n\nThe search went on."),
    ],
)
def test_no_points_outweigh_text(html, text):
    assert main_text(html, best_path(html)) == text


def test_furniture_is_what_many_pages_of_a_host_share(make):
    page = "<body><div class='top'><p>Welcome to the site</p></div><div class='post'><p>Text {0} of its own.</p><div class='share'>Tell a friend</div>" \
           "<div class='share'>Number {0} shares</div></div><div class='foot'><p>All about us</p></div></body>"
    rows = [(i, "http://many.test/a", page.format(i)) for i in range(6)]
    rows += [(10 + i, "http://copies.test/a", page.format(77)) for i in range(6)] + [(20, "http://one.test/", page.format(5))]
    got = {r.page_id: r.text for r in html_extract.extract(make(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} of its own.\n\nNumber {i} shares" for i in range(6))
    # Copies of one page, and a page alone on its host, show nothing to be furniture.
    assert got[10] == got[15] == "Welcome to the site\n\nText 77 of its own.\n\nTell a friend\n\nNumber 77 shares\n\nAll about us"
    assert got[20].startswith("Welcome")


@pytest.mark.parametrize(
    "html",
    [
        "<div>x" * 100_000, "<div>" * 50_000 + "<p>y" * 50_000, "<div class='ad'>x" * 100_000, "<p>" + "<b>x" * 100_000, "<ul><li>x" * 50_000,
        "<a href=x>" * 50_000 + "</i>" * 50_000 + "text",
    ],
)
def test_deep_pages_take_linear_time(html):
    import time

    begun = time.process_time()
    page = html_extract.parse(html)
    text = html_extract.main_text(page, html_extract.best_path(page)[0])
    assert time.process_time() - begun < 4 and text
