"""Main texts: the given pages by their template, malformed markup by hand, and hosts whose pages outvote one of them."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import pages
from tallyframe.llm.pages import Page
from tallyframe.llm.queries import QUERIES


def template_text(source):
    """The text of the given pages, whose main text is their only article."""
    inner = re.search(r"<article>(.*?)(</article>|$)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    return "\n".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if b)


def test_query_by_the_template(spark):
    folder = "/root/testdata/sf0.001"
    source = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op11_host_paths"](spark, folder).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(source)
    for r in rows:
        assert r["text"] == template_text(source[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) > 0
        assert r["url"] == source[r["page_id"]]["url"]


FULL = (
    '<html><head><title>T</title><meta charset=x></head><body class="has-sidebar"><div class="cookie-notice">cookies!</div><div id="page" class="with-sidebar"><header>H</header>'
    '<nav><a href=x>m</a></nav><main><div class="post post-12"><h1>A &lt;title&gt;</h1><div class=body><p>one<p>two &amp; <b>three</b><br>four<ul><li>a<li>b</ul>'
    '<table><tr><td>c<td>d</table><form>f<input></form></div><div class="share-buttons">share</div></div><section id=comments><article class="comment">a comment much longer than '
    "all the rest of this page, so that it would win by its length</article></section></main><aside>side</aside></div><footer>foot</footer>"
)


@pytest.mark.parametrize(
    "source, text",
    [
        (FULL, "A <title>\none\ntwo & three four\na\nb\nc\nd"),
        ("", ""),
        ("<", "<"),
        ("a < b &lt; c", "a < b < c"),
        ("<div><div><div>", ""),
        ("<p>open <a href='x>y'>link</a> text<script>var a='</p>'; if(a<b){}</script> more <!-- c > --> end &nbsp;\n x", "open link text more end x"),
        ("<div hidden>x</div><p>y</p></p></div>z", "y\nz"),
        ("<p>a <b>b<p>c</b> d", "a b\nc d"),
        ("<script>never ends <p>x</p>", ""),
        ("<p>cut off <p class='a", "cut off"),
        ("<b>x<p>y</b>z</p>", "x\nyz"),
        ("<p>it's <span title='a > b'>fine</span>&#x41;&copy", "it's fineA©"),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "a\nb\nc\nd"),
    ],
)
def test_markup(source, text):
    assert Page(source).main_text([])[0] == text


def test_long_and_deep_pages():
    deep = Page("<div>" * 5_000 + "x" + "</div>" * 4_000 + "y")
    assert deep.main_text([])[0].startswith("x")
    assert Page("<p>word <b>x" * 20_000).main_text([])[0].count("\n") == 19_999


def page(body, side):
    return f'<body><div class="top">Site</div><div class="wrap"><div class="story n12">{body}</div><div class="rail">{side}</div></div></body>'


def test_host_outvotes_a_page(spark):
    good = [(i, "https://news.example.org/a", page(f"<h2>Title {i}</h2><p>{'word ' * 60}{i}</p>", "<p>tiny</p>")) for i in range(9)]
    # here the rail is as long as the story, so the page by itself would take both
    odd = (9, "http://user@NEWS.example.org:80/b", page("<p>short but right " + "w " * 30 + "</p>", "<p>" + "rail " * 20 + "</p>"))
    alone = (10, "https://other.example.org/", odd[2])
    other = [(11, None, odd[2]), (12, "https://news.example.org/c", None), (13, "https://news.example.org/c", "<p>no such path</p>"), (14, "not a url", ""), (14, "not a url", "")]
    rows = spark.createDataFrame([*good, odd, alone, *other], "page_id long, url string, html string").select("*", F.lit("x").alias("text"), F.lit("y").alias("a.b"), F.lit("z").alias("host"))
    out = {r["page_id"]: r for r in pages.main_text(rows).collect()}
    right = "short but right " + " ".join("w" * 30)
    assert out[0]["text"] == "Title 0\n" + "word " * 60 + "0" and out[0]["path"] == "div.wrap>div.n0.story"
    assert out[9]["text"] == right and out[9]["path"] == "div.wrap>div.n0.story"
    assert "rail rail" in out[10]["text"] and "rail rail" in out[11]["text"]
    assert out[12]["text"] == out[14]["text"] == "" and out[13]["text"] == "no such path"
    assert out[0]["a.b"] == "y" and out[0]["host"] == "z"
    assert pages.main_text(rows).count() == 16 and pages.main_text(rows.where("false")).count() == 0


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(tuple(r) for r in pages.main_text(rows).collect())
    monkeypatch.setattr(pages, "BROADCAST", -1)
    assert sorted(tuple(r) for r in pages.main_text(rows).collect()) == want
