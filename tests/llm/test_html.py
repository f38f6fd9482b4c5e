from __future__ import annotations

import html as entities
import json
import re
import time

import pytest

from queuemill.llm import html_wrappers as H
from queuemill.llm.html_tree import blocks, parse
from queuemill.llm.queries import QUERIES


def text_of(source):
    return "\n".join(blocks(parse(source)))


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p>a<p>b</p>c", "a\nb\nc"),
        ("a &amp; b&nbsp;&#233;&#x65E5;<br>c \n\t d", "a & b é日 c d"),
        ("<p><b>one <i>two</b> three</i></p>", "one two three"),
        ("<ul><li>a<li>b <ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<script>var x = '<p>no</p>';</script><style>p{}</style><p>yes", "yes"),
        ("<script>never closed <p>no", ""),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><!-- open", "yes"),
        ("<nav>menu</nav><aside>side</aside><footer>foot</footer><form>ask<input></form><p>x", "x"),
        ("<header>site</header><article><header><h1>T</h1></header><p>x</p></article>", "T\nx"),
        ("<div class='sidebar left'>no</div><div id=comments>no</div><div class=cookie-notice>no</div><p>x", "x"),
        ("<div class='adventure'>yes</div><div class='ad-slot'>no</div><div hidden>no</div>", "yes"),
        ("<div class='with-sidebar'><p>a</p><article class='post social'>b</article></div>", "a\nb"),
        ("<article>a</article><div id=comments><article>b</article></div><article class=comment>c</article>", "a"),
        ("", ""),
        ("<", "<"),
        ("1 < 2 <p", "1 < 2 <p"),
        ("</p></div>x<br/>y<img src=x>z", "x yz"),
    ],
)
def test_blocks(source, text):
    assert text_of(source) == text


def test_deep_and_long_sources():
    assert text_of("<div>" * 5_000 + "x") == "x"
    assert len(text_of("<p>" + "word " * 200_000)) == 5 * 200_000 - 1
    assert text_of("<b" * 20_000)  # no tag ever ends: plain text, in reasonable time


def shape(source):
    return json.dumps(H.skeleton(parse(source)))


def test_folding():
    assert shape("<h1>a</h1><p>b<p>c<p>d") == shape("<h1>x</h1><p>y<p>z")
    assert shape("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>") == shape("<h2>a</h2><p>b</p>" * 5)
    assert H.skeleton(parse("<h2>a</h2><p>b</p>" * 3)) == [["()", 1, 0, [["h2", 0, 0, []], ["p", 0, 0, []]]]]


def test_alignment_gives_optional_and_repeated_parts():
    a, b = (H.skeleton(parse(x)) for x in ("<h1>a</h1><p>b</p>", "<h1>a</h1><hr><p>b</p><p>c</p>"))
    for whole in (H.align(a, b), H.align(b, a)):
        assert H.wrapper_text(whole, {"/p": "#text"}) == "<h1></h1>(<hr></hr>)?(<p>#text</p>)+"
    assert H.align(a, a) == a


BODY = "<p>{}</p>" * 3


def test_main_region_without_an_article(spark):
    """No element says what it is: the template's texts never change, the main region's do."""
    rows = []
    for i in range(8):
        body = BODY.format(f"first text {i} " * 9, f"second &lt;text&gt; {i} " * 9, f"third {i} " * 9)
        extra = "<div class='box'>On some pages only</div>" if i % 2 else ""
        page = f"<html><body><div class='top'>Welcome to this site</div><div class='text'>{body}</div>{extra}<div class='end'>All rights</div></body></html>"
        rows.append((i, f"https://Host.example/{i}", page))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = H.wrappers(pages, bundle=2).collect()
    assert [(r["host"], r["pages"], r["main_path"]) for r in found] == [("host.example", 8, "/html/body/div.text")]
    assert found[0]["wrapper"] == (
        "<html><body><div.top>#same</div><div.text>(<p>#text</p>)+</div>(<div.box>#same</div>)?"
        "<div.end>#same</div></body></html>"
    )
    texts = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert texts[3] == "\n".join([("first text 3 " * 9).strip(), ("second <text> 3 " * 9).strip(), ("third 3 " * 9).strip()])


def test_odd_pages(spark):
    rows = [
        (1, "http://a.example/x", None), (2, None, "<article>x &amp; y</article>"), (2, None, "<article>x &amp; y</article>"),
        (None, "no url", "<p>one<p>two"), (3, "http://a.example/", ""), (4, "http://a.example:80/?q", "<article><p>Long " + "w " * 50_000),
        (5, "http://a.example/", "plain text only"), (6, "http://a.example/", "<nav>only a menu</nav>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as text", "'mine' as host", "1 as main_path")
    got = sorted(((r["page_id"], r["text"][:12], r["n_chars"]) for r in H.extract(pages).collect()), key=str)
    assert got == sorted(
        [(1, "", 0), (2, "x & y", 5), (2, "x & y", 5), (None, "one\ntwo", 7), (3, "", 0), (4, "Long w w w w", 100_004),
         (5, "plain text o", 15), (6, "", 0)], key=str,
    )
    assert H.extract(pages.limit(0)).count() == 0


def article(source):
    """By the rules of the test pages: their article is marked as such, its blocks are h1 and p."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li)>", inner)
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_query_finds_the_articles(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op1_html_wrappers"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for row in got:
        assert row["text"] == article(pages[row["page_id"]]["html"])
        assert row["url"] == pages[row["page_id"]]["url"] and row["n_chars"] == len(row["text"])


def test_deep_and_broken_pages_end_no_job(spark):
    """Ten thousand nested elements, a megabyte of tags without ends, beside an ordinary page of the same host."""
    deep = "<div>" * 10_000 + "at the bottom" + "</div>" * 10_000
    inline = "<b>" * 10_000 + "bold"
    broken = ["<b " * 350_000, '<a x="' * 170_001 + ">", "<!x" * 300_000, "</z>" * 200_000, "<" * 500_000]
    sound = "<html><body><nav>menu</nav><article><p>One.</p><p>Two.</p></article></body></html>"
    rows = [(i, "https://h.example/x", source) for i, source in enumerate([deep, inline, *broken, sound])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    begun = time.monotonic()
    found = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert time.monotonic() - begun < 120
    assert found[0] == "at the bottom" and found[1] == "bold"
    assert found[len(rows) - 1] == "One.\nTwo."
    alone = spark.createDataFrame([(1, "https://deep.example/", deep), (2, "https://deep.example/", deep.replace("bottom", "end"))], pages.schema)
    assert [r.text for r in H.extract(alone).orderBy("page_id").collect()] == ["at the bottom", "at the end"]


@pytest.mark.parametrize("source,text", [
    ("<b one", "<b one"), ("a<b c>d</b>", "ad"), ('<a x=">">y</a>', "y"), ('<a x="y>z', '<a x="y>z'), ("x <!-- <p> y", "x"),
    ("<p a='>' b=\">\">t", "t"), ("1 < 2 > 0", "1 < 2 > 0"), ("<!doctype html>t", "t"), ("<!x", "<!x"), ("a<br/>b", "a b"),
])
def test_what_is_a_tag(source, text):
    assert text_of(source) == text
