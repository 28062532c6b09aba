"""Operator 12 on pages whose main text was written down by hand, on odd and very long ones, and against the table's template."""

import os
import re
import time
from html import unescape

import pytest

from termweave.llm import htmltext

LONG = "The river rose in the night, and by morning the lower streets, the market and the old mill stood in water up to the sills."
MORE = "Nobody was hurt, said the mayor, though many cellars, shops and stores were ruined, and the bridge stays closed until Friday."
LINKS = '<ul><li><a href="/a">Home, sweet home</a></li><li><a href="/b">All news, all day</a></li></ul>'


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


PAGES = {
    "article": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{LINKS}</nav><article><h1>Flood</h1><p>{LONG}<p>{MORE}</article><footer>(c) us, them</footer></body></html>", f"Flood {LONG} {MORE}"),
    "divs": (f'<body><div id="header"><h1>Daily</h1></div><div class="leftMenu">{LINKS}</div><div id="content"><h1>Flood</h1><p>{LONG}</p><p>{MORE}</p><p>Short.</p></div><div id="sidebar"><p>{LONG} {MORE} {LONG}</p></div></body>', f"Flood {LONG} {MORE} Short."),
    "no hints": (f"<body><div><a href=/>Home</a> <a href=/b>All, of, it</a></div><div><div><p>{LONG}</p><p>{MORE}</p></div><div><p>{MORE}</p><p>{LONG}</p></div></div><div>Printed in Linz</div></body>", f"{LONG} {MORE} {MORE} {LONG}"),
    "comments": (f'<article><p>{LONG}</p><section id="comments"><article class="comment"><p>{MORE} {MORE} {MORE}</p></article></section><div class="post-comments">{MORE}</div></article>', LONG),
    "notices": (f'<body><div class="cookie-notice"><p>{MORE} {MORE}</p></div><div role="alert">{MORE}</div><main><p>{LONG}</p><form><p>{MORE}</p><input></form><aside>{MORE}</aside><div class="ad-slot">{MORE}</div><p hidden>{MORE}</p><p style="display: none">{MORE}</p></main>', LONG),
    "headers": (f'<body><header><p>{MORE}</p></header><article><header><h1>Flood</h1></header><div class="entry-content"><p>{LONG}</p></div><footer>By A, B and C</footer></article></body>', f"Flood {LONG}"),
    "sections": (f"<article><section><p>{LONG}</p><p>{LONG}</p></section><section><p>Short.</p></section><section><h2>Then</h2><ul><li>one</li><li>two</ul></section></article>", f"{LONG} {LONG} Short. Then one two"),
    "siblings": (f'<div><h1>Flood</h1><div class="lead">{LONG}</div><div><p>{MORE}</p><p>{LONG}</p><p>{MORE}</p></div><p>The end.</p><p><a href="/x">More of this, and that</a></p></div>', f"Flood {LONG} {MORE} {LONG} {MORE} The end."),
    "inline": (f"<article><p>{LONG} <b>bo</b>ld&nbsp;\n\t<i>it</i> a<br>b &amp; &lt;p&gt; &#233;&eacute;&#x1F600; <a href='x>y'>link</a></p></article>", f"{LONG} bold it a b & <p> éé😀 link"),
    "broken": (f"<article><p><b>{LONG}<br><p>{MORE}</i></b><div>x</article></p>", f"{LONG} {MORE} x"),
    "scripts": (f'<article><script>var t="</p><p>no";</script><p>{LONG}<!-- <p>no</p> --><noscript>no</noscript><template><p>no</p></template><svg><text>no</text></svg></p><textarea>no</textarea></article>', LONG),
    "layout": (f'<body><div class="layout sidebar-right"><div class="sidebar"><p>{MORE} {MORE}</p></div><article><p>{LONG}</p></article></div></body>', LONG),
    "layout alone": (f'<body><div class="sidebar"><article><p>{MORE} {MORE}</p></article></div><div id="content"><article><p>{LONG}</p></article></div></body>', LONG),
    "sidebar article": (f'<body><div class="rightSidebar"><p>{MORE} {MORE}</p></div><div><p>{LONG}</p></div></body>', LONG),
    "comment bodies": (f'<main><p>{LONG}</p><ol class="commentlist"><li><article class="comment-body"><p>{MORE} {MORE} {MORE}</p></article></ol><article class="comment-body"><p>{MORE}</p></article></main>', LONG),
    "beside": (f'<body><div class="content no-sidebar"><p>{LONG}</p></div></body>', LONG),
    "table": (f"<table><tr><td>{LINKS}<td><p>{LONG}<p>{MORE}<tr><td>x</table>", f"{LONG} {MORE}"),
    "small": ('<body><div class="ad">Buy, buy, buy, buy, buy and buy again, all of you.</div><article><h1>Of.</h1><p>Of.</p></article><footer>No, no, no, no, no</footer></body>', "Of. Of."),
    "heads alone": ("<body><nav>a</nav><article><h1>Only this</h1></article></body>", "Only this"),
    "text": ("just, text", "just, text"), "nothing": ("<nav>a</nav>", ""), "empty": ("", ""), "null": (None, ""), "entities": ("&am &amp &ampx; a&lt", "&am & &x; a<"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(name):
    html, text = PAGES[name]
    assert htmltext.extracted(html) == text


def test_whole_texts():
    """Nothing is cut: a page of 20,000 paragraphs, and one paragraph of a million characters."""
    own = [f"{LONG} {i}." for i in range(20_000)]
    assert htmltext.extracted(f"<body><nav>x</nav>{''.join(f'<p>{p}' for p in own)}</body>") == " ".join(own)
    assert htmltext.extracted(f"<article><p>{'a, ' * 350_000}</p></article>") == ("a, " * 350_000).strip()


@pytest.mark.parametrize("html", ["<div>" * 100_000 + LONG, '<a "' * 100_000, "<" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<ul>" + "<div><li>x</li>" * 60_000, "<p>a, b." * 100_000, "<noscript>x" * 60_000, "<!--" * 100_000, "<table>" + "<tr><td>x" * 60_000, "<p><button>" + "<div>" * 60_000, "<p " + "a=b " * 200_000 + ">x"])
def test_odd_pages_take_linear_time(html):
    began = time.time()
    htmltext.extracted(html)
    assert time.time() - began < 5


def test_rows(spark):
    rows = [(1, "u", PAGES["divs"][0], 3, "x"), (1, "u", PAGES["divs"][0], 3, "x"), (None, None, None, None, None), (2, "v", "", 0, "y"), (2**53 + 1, "w", PAGES["inline"][0], 1, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = sorted((tuple(r) for r in htmltext.main_text(pages).collect()), key=repr)
    assert got == sorted(((i, u, htmltext.extracted(h), len(htmltext.extracted(h))) for i, u, h, *_ in rows), key=repr)
    assert htmltext.main_text(pages.limit(0)).count() == 0
    assert htmltext.main_text(pages.withColumn("tag", pages["n_chars"]), keep=("tag",)).columns == ["page_id", "url", "text", "n_chars", "tag"]


def test_template_of_the_table(spark):
    """Every page of the table holds its main text in one article of flat blocks, so that a pattern can cut it out."""
    from termweave.llm.common import table

    html = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.001", "pages").collect()}
    got = {r.page_id: r for r in htmltext.op12_main_text(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(html)
    for key, h in html.items():
        blocks = re.split(r"</?(?:p|h1|br|article)>", re.sub(r"</?b>", "", h[h.index("<article>") : h.index("</article>")]))
        text = " ".join(b for b in (" ".join(unescape(x).split()) for x in blocks) if b)
        assert (got[key].text, got[key].n_chars) == (text, len(text))
