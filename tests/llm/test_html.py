"""Main text of pages: the reader, the trees and the choice for a whole page."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest

from broadsheet.llm import html_text, queries


def kept(page, told=None):
    """The text by the page's own names."""
    read = html_text.Page(page)
    _, told = read.describe()
    return read.text(np.array([0.1 if t == 0 else 0.9 for t in told]))


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<b>b</b>c<br>d</p>e", "abc d e"),
        ("<p>one<p>two</div><li>three", "one two three"),
        ("<script>var a='<p>x</p>';</script><style>p{}</style><p>y</p>", "y"),
        ("<!-- <p>x</p> --><p>y</p><!-- open", "y"),
        ("<title>t</title><p title='a>b' class=\"c>d\">x</p>", "x"),
        ("<p>&lt;b&gt;&nbsp;&#233;&#x1F642; 5 < 6</p>", "<b> é🙂 5 < 6"),
        ("<nav>menu</nav><article><h1>T</h1><p>a</p><aside>s</aside><p>b</p></article><footer>f</footer>", "T a b"),
        ("<div class='ad'>buy<p>now</p></div><div class='article'><p>x</p><div id=comments><p>me</p></div></div>", "x"),
        ("<form><p>name</p><input></form><header>h</header><main>m</main>", "m"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<P>UP</P><BR/>down<a href=x>er", "UP down er".replace("down er", "downer")),
        ("x</p>y</b>z", "x yz"),
        ("<p>text<a", "text"),
    ],
)
def test_pages(page, text):
    assert kept(page) == text


SITE = "<nav>menu</nav><div id=page class='{}'><article><h1 class='{}'>T</h1><p class='{}'>a long text</p></article><div class='site-footer'>f</div></div>"


@pytest.mark.parametrize("outer", ["single has-sidebar", "menu-closed", "single", "with-ads no-comments", "sidebar"])
@pytest.mark.parametrize("heading, paragraph", [("", ""), ("article-header", "form"), ("header", "notice")])
def test_names_around_an_article_do_not_empty_it(outer, heading, paragraph):
    site = SITE.format(outer, heading, paragraph)
    assert kept(site) == "T a long text"
    assert kept(f"<html><body class='{outer}'>{site}</body></html>") == "T a long text"


def test_names_without_an_article():
    long = "x " * 200
    assert kept(f"<body class='menu-open'><div class='ads'>{long}</div><div class='post-comments'>c</div></body>") == long.strip()
    assert kept("<div class=post><p>a b c</p></div><div class='widget-area'>w</div><div id=primary-menu>m</div>") == "a b c"
    # Comments that are articles themselves are comments.
    assert kept("<article><p>a</p></article><div class=comments><article class=comment-body>c</article></div>") == "a"


def test_list_items_close_within_deep_inline_markup():
    assert kept("<ul><li><b><i><u><s><em>a<li>b</ul>c") == "a b c"
    deep = html_text.Page("<ul>" + "<li><b><i><u><s><em>a" * 3)
    assert [deep.parents[i] for i, t in enumerate(deep.tags) if t == "li"] == [1, 1, 1]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<img alt=\"reader's view\"><p>Long text isn't lost</p><p>b</p>", "Long text isn't lost b"),
        ("<img alt=\"reader's view\"><p>to the end</p>", "to the end"),
        ("<p><a title=\"5\" tall\">x</a> y</p>", "x y"),
        ("<p><a title='5' tall'>isn't</a> y</p>", "isn't y"),
        ("<p a = 'x>\"y' b=\"c>'d\" e=f'g>it's</p>", "it's"),
        ("<p><a href=\"x>y</p><p>z</p>", "y z"),
        ("<p>a<svg width='5'/>b</p><p>c</p>", "ab c"),
        ("<p>a<svg/></p><p>c</p><svg><text>t</text></svg>d", "a c d"),
        ("<p>a<svg a='/>'><text>t</text></svg>d", "ad"),
    ],
)
def test_quotes_open_values_only(page, text):
    assert kept(page) == text


@pytest.mark.parametrize("part", ["a='b' ", "a=\"", "a='\" ", "= ", "/ ", "a =\n", "' \""])
def test_long_tags_are_read_in_linear_time(part):
    start = time.time()
    assert kept("<p " + part * 200_000) == ""
    assert time.time() - start < 20


@pytest.mark.parametrize("part", ["<p>", "<div>", "<a \"", "<script>", "<!--", "<", "</p>", "<li>", "<b>x", "<a href='>", "<td>"])
def test_any_markup_is_read_in_linear_time(part):
    start = time.time()
    read = html_text.Page(part * 40_000 + "end")
    read.text(np.full(len(read.describe()[0]), 0.9))
    assert time.time() - start < 20


def test_a_dropped_node_drops_all_below():
    page = html_text.Page("<div><div><p>a</p></div><p>b</p></div><p>c</p>")
    assert page.tags == ["#root", "div", "div", "p", "p", "p"]
    rows = {
        # The outer block is unlikely, but what lies in it is much more likely.
        "a b c": [0.9, 0.4, 0.9, 0.9, 0.9, 0.9],
        "c": [0.9, 0.01, 0.6, 0.6, 0.6, 0.9],
        "b c": [0.9, 0.9, 0.01, 0.9, 0.9, 0.9],
        "": [0.9, 0.01, 0.5, 0.5, 0.5, 0.1],
    }
    for text, chances in rows.items():
        assert page.text(np.array(chances)) == text


def article(page):
    """The article of a page as the test data writes it."""
    inner = re.search("<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())


def test_query_gives_the_articles(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op9_html(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, article(pages[r.page_id].html), len(r.text))


def pages_of(n):
    """Pages of several designs; in half of them only names of blocks tell."""
    rows = []
    for i in range(n):
        words = [f"word{i}x{j}" for j in range(60)]
        body = "".join(f"<p>{' '.join(words[k : k + 20])}, and so on.</p>" for k in (0, 20, 40))
        side = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(6))
        notes = "<div class='comments'><div><p>nice one</p></div><div><p>first</p></div></div>"
        if i % 2:
            page = f"<header><h1>Site</h1></header><nav><ul>{side}</ul></nav><main>{body}</main>{notes}<footer>(c)</footer>"
        else:
            page = f"<div class='sidebar'><ul>{side}</ul></div><article>{body}</article><div class='cookie notice'>We use cookies</div>{notes}"
        rows.append((i, f"u{i}", f"<html><head><title>t</title></head><body>{page}</body></html>", body))
    return rows


def test_trees_learn_other_designs(spark):
    rows = pages_of(120)
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    model = html_text.fit(pages)
    plain = [(i, u, h.replace("<main>", "<div>").replace("</main>", "</div>").replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, h, _ in rows]
    for given in ([r[:3] for r in rows], plain):
        frame = spark.createDataFrame(given, "page_id long, url string, html string")
        for r in html_text.extract(frame, model).collect():
            want = " ".join(re.sub("<[^>]*>", " ", rows[r.page_id][3]).split())
            assert r.text == want


def test_exported_trees_give_sparks_scores(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rnd = np.random.default_rng(1)
    x = rnd.random((300, 4))
    rows = [(float((a[0] > 0.5) ^ (a[1] > 0.3)), Vectors.dense(a)) for a in x]
    frame = spark.createDataFrame(rows, "label double, features vector") if False else spark.createDataFrame(rows, ["label", "features"])
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(frame)
    want = [r.probability[1] for r in model.transform(frame).collect()]
    assert np.allclose(html_text.Trees(model).chances(x), want)


def test_edges(spark):
    rows = [(1, None, None, "x", "y"), (1, "u", "", "x", "y"), (None, "u", "<p>a</p>", None, None), (2, "v", "<p>" + "long " * 50_000 + "</p>", "", "")]
    pages = spark.createDataFrame(rows + rows[2:3], "page_id long, url string, html string, text string, features string")
    assert html_text.fit(pages) is None
    got = sorted((r.page_id or 0, r.url or "", r.text) for r in html_text.extract(pages, None).collect())
    assert got == sorted([(1, "", ""), (1, "u", ""), (0, "u", "a"), (0, "u", "a"), (2, "v", ("long " * 50_000).strip())])
    none = pages.where("false")
    assert html_text.fit(none) is None and html_text.extract(none, None).count() == 0
