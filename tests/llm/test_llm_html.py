"""The main text of pages: marks, templates of hosts, malformed markup."""

from __future__ import annotations

import pytest

from quillstone.llm import common
from quillstone.llm.html_extraction import INSIDE, OUTSIDE, Page, extract

NONE = frozenset()


def text(html: str) -> str:
    return Page(html).main_text(NONE, NONE)[0]


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("plain  words", "plain words"),
        ("<p>a<p>b", "a\n\nb"),
        ("<article><h1>T</h1><p><b>One.<br><p>Two &amp; three&#33; &am &ampx</p></article><footer>f</footer>", "T\n\nOne.\n\nTwo & three! &am &x"),
        ("<nav>n</nav><p>x</p><script>var a='</p>';</script><style>p{}</style><p>y</p><!-- <p>no</p> -->", "x\n\ny"),
        ("<article>a<script>b", "a"),
        ("<p>cut <a href='", "cut"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ('<p title="a > b">x</p>', "x"),
        ("<ul><li>a<li>b <i>c</i>d</ul>", "a\n\nb cd"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b\n\nc"),
        ("<body class='has-sidebar'><div id='content'><p>x</p></div><div class='sidebar'>s</div></body>", "x"),
        ("<div class='wrap with-sidebar'><article><p>x</p></article><aside>s</aside></div>", "x"),
        ("<nav>n<article><p>never closed menu</p></article>", "never closed menu"),
        ("<main><p>m</p><section id=comments><p>c</p></section></main><p>after</p>", "m"),
        ("<article><p>a</p><article class=comment><p>c</p></article></article>", "a"),
        ("<article><header><h1>T</h1></header><p>a</p><footer>by x</footer></article><header>site</header>", "T\n\na"),
        ("<article><p>a</p><div class='cookie-notice'>n</div><form><p>f</p></form><div role='dialog'>d</div><p hidden>h</p><div style='display: none'>i</div></article>", "a"),
        ("<article><p>a <span class='adSlot'>ad</span> b</p></article>", "a b"),
        ("<ARTICLE><P>A \n B</P></ARTICLE>", "A B"),
        ("<article></article><p>x</p>", ""),
        ("<article><p>a</div>b</p></article>c", "ab"),
    ],
)
def test_page(html, want):
    assert text(html) == want


def test_long_and_deep_pages_take_linear_time():
    assert text("<div>" * 20_000 + "<p>x") == "x"
    assert text("<span>" * 50_000 + "</div>" * 50_000 + "y") == "y"
    assert len(text("<p>a</p>" * 50_000).split("\n\n")) == 50_000
    assert text("<article class=comment>" * 5_000 + "<article><p>z") == "z"
    assert Page("<div>" * 20_000 + "x").subtrees()


def page(menu: str, body: str, more: str = "") -> str:
    return f"<html><body><div class='x1'><a href='/{menu}'>{menu}</a></div>{body}{more}</body></html>"


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_templates_of_hosts(spark, monkeypatch, sent):
    """Parts without any mark go where they recur across a host's articles; what copies of a page or many articles share stays."""
    monkeypatch.setattr(common, "SENT_VALUES", sent)
    data, want = [], {}

    def add(host, html, expected):
        i = len(data)
        data.append((i, f"https://{host}/p{i}", html, 7, "t"))
        want[i] = expected

    n = 2 * INSIDE
    for i in range(n):  # a paragraph that most articles share stays, a box that all have goes, a copyright line outside goes
        add("many.example", page("Home", f"<article><p>Own text {i}.</p><p>Shared passage.</p><div>Follow us!</div></article>", "<div>All rights.</div>"), f"Own text {i}.\n\nShared passage.")
    for i in range(n):  # without articles: the menu recurs, the text does not
        add("plain.example", page("Start", f"<div><p>Line {i}</p></div>"), f"Line {i}")
    for _ in range(n):  # copies of one page are one article: nothing recurs
        add("copies.example", page("Same", "<article><div>All the text.</div><p>More of it.</p></article>"), "All the text.\n\nMore of it.")
    for i in range(OUTSIDE - 1):  # too few pages to tell
        add("few.example", page("Menu", f"<div><p>Row {i}</p></div>"), f"Menu\n\nRow {i}")
    add("Few.Example:8080", None, "")
    data.append((None, None, "<article>no host</article>", 1, None))
    schema = "page_id long, url string, html string, n_chars long, text string"
    got = extract(spark.createDataFrame(data, schema).repartition(5)).collect()
    assert len(got) == len(data)
    assert {r.page_id: r.text for r in got if r.page_id is not None} == want
    assert [(r.text, r.n_chars, r.url) for r in got if r.page_id is None] == [("no host", 7, None)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.n_template for r in got if r.url and "many" in r.url} == {3} and {r.n_template for r in got if r.url and "copies" in r.url} == {0}


def test_no_pages_and_repeats(spark):
    schema = "page_id long, url string, html string"
    assert not extract(spark.createDataFrame([], schema)).collect()
    got = extract(spark.createDataFrame([(1, "http://a/", "<p>x</p>")] * 3 + [(2, "", ""), (3, "no url", None)], schema)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, "x")] * 3 + [(2, ""), (3, "")]


def test_templates_do_work_on_the_tables(spark):
    got = extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert got.selectExpr("sum(n_template)").first()[0] > 0
