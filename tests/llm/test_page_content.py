import itertools
import re
from html import unescape

import numpy as np
import pytest

from attesta.llm import page_content, queries
from attesta.llm.page_samples import labelled_pages
from attesta.llm.page_tree import parse


@pytest.fixture(scope="module")
def model():
    return page_content.fit()


def leaves(html):
    t = parse(html)
    return [(t.tags[t.parents[i]], x) for i, x in enumerate(t.texts) if x]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a<b>b<br>c<p>d</p>e", [("p", "ab c"), ("p", "d"), ("html", "e")]),
        ("<body><p> x \n\t y </p><!-- <p>no</p> -->z", [("p", "x y"), ("body", "z")]),
        ("<script>var t='</p>';if(a<b)</script><style>p{}</style><p>1 < 2 &amp; 3&lt;4 &copy</p>", [("p", "1 < 2 & 3<4 ©")]),
        ("<div title=\"a>b\" x='>'>t</div><p don't>u</p>", [("div", "t"), ("p", "u")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("li", "a"), ("li", "b"), ("li", "c"), ("li", "d")]),
        ("<table><tr><td><p>a<td>b<tr><td>c</table>d", [("p", "a"), ("td", "b"), ("td", "c"), ("html", "d")]),
        ("<article><p>a</article>b</div></p><h2>c</h3>d<p>cut <a hre", [("p", "a"), ("html", "b"), ("h2", "c"), ("html", "d"), ("p", "cut")]),
        ("<dl><dt>a<dd>b<dt>c</dl><P>Big</P><textarea>no</textarea>&am &nbsp;&#228;", [("dt", "a"), ("dd", "b"), ("dt", "c"), ("p", "Big"), ("html", "&am ä")]),
        ("<title>t</title><![CDATA[x]]><?php y ?></ z>w<svg><text>no</text></svg>", [("html", "w")]),
        ("", []), (None, []), ("<", [("html", "<")]), ("plain", [("html", "plain")]),
    ],
)
def test_tree(html, want):
    assert leaves(html) == want


def test_links_are_counted():
    t = parse("<p>ab <a href=x>cd</a> ef<p><a>gh<p>ij</p>")
    assert [(x, t.linked[i]) for i, x in enumerate(t.texts) if x] == [("ab cd ef", 2), ("gh", 2), ("ij", 0)]


def test_long_and_deep_pages():
    assert len(leaves("<div>" * 20000 + "x" + "</div>" * 20000)) == 1
    assert len(leaves("<p>word " * 50000)) == 50000
    assert leaves("<!--" * 50000) == [] and leaves("<a b='" * 2000)[:1] in ([], [("html", "")])


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    for parents in ([-1], [-1, 0, 0, 1, 1, 2], [-1, 0, 1, 2, -1, 4, 4], [-1, 0, 0, 0, 3, 3]):
        trees, at = [], [i for i, p in enumerate(parents) if p < 0]
        for a, b in itertools.pairwise([*at, len(parents)]):
            t = parse("")
            for p in parents[a + 1 : b]:
                t.tags.append("p")
                t.parents.append(p - a)
                t.attributes.append("")
                t.texts.append("")
                t.linked.append(0)
            trees.append(t)
        f = page_content.forest(trees, {}, {})
        n = len(parents)
        unary, edges = rng.normal(size=n), rng.normal(size=(3, 2, 2))
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            score = sum(unary[i] * y[i] for i in range(n))
            score += sum(edges[f.kinds[i], y[p], y[i]] for i, p in enumerate(parents) if p >= 0)
            w = np.exp(score)
            total += w
            ones += w * np.array(y)
            for i, p in enumerate(parents):
                if p >= 0:
                    pairs[i, y[p], y[i]] += w
        content, joint, log_z = page_content.marginals(f, unary, edges)
        assert np.allclose(content, ones / total) and np.allclose(joint, pairs / total) and np.isclose(log_z, np.log(total))


def test_held_out_pages(model):
    trees = [parse(p) for p in labelled_pages(300, seed=9)]
    right = whole = n = 0
    for tree, blocks in zip(trees, page_content.blocks_of(trees, model, {}), strict=True):
        want = [bool(y) for y, t in zip(page_content.labels_of(tree), tree.texts, strict=True) if t]
        got = [p >= 0.5 for _, p in blocks]
        n += len(want)
        right += sum(a == b for a, b in zip(want, got, strict=True))
        whole += want == got
    assert right >= 0.98 * n and whole >= 0.9 * len(trees)


def by_pattern(html):
    """The article of the given pages, whose layout is known here."""
    article = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_query_on_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.QUERIES["op13_main_text"](spark, sf).collect()}
    assert len(got) == len(pages)
    assert all(got[p.page_id].text == by_pattern(p.html) and got[p.page_id].url == p.url for p in pages)
    assert all(r.n_chars == len(r.text) for r in got.values())


LAYOUTS = [
    '<body><div id="cookie-bar"><p>We use cookies to make this site work well for you.</p><button>OK</button></div>'
    '<div class="nav-menu"><a href=a>Home</a> <a href=b>News</a></div><div class="post-content"><h1>{0}</h1><p>{1}<p>{2}'
    '<div class="advert">Buy our things, now, today.</div><p>{3}</div><div id="comments"><div class="comment"><p>I do not agree with '
    "this at all, it is wrong.</p></div></div><div class=\"sidebar\"><h3>Popular</h3><p>Some words about this site.</p></div><footer>(c) 2020</footer>",
    "<header><h2>The Site</h2><nav><ul><li><a href=/>Home</a></ul></nav></header><main><article><h1>{0}</h1><p>{1}</p><ul><li>{2}</ul><p>{3}</p>"
    '<form class="newsletter"><p>Get our letter by mail every week.</p><input></form></article><section class="comments"><h2>Comments</h2>'
    "<article><p>What a good text, thank you for it.</p></article></section></main><aside><p>About the author of all this, in some words.</p></aside>"
    "<footer><p>All rights reserved, terms and so on.</p></footer>",
]


def test_other_layouts(spark, model):
    parts = ["A new house by the river", "The house was built in two years, and it stands on the old hill.", "Short one.", "In the end, all of them moved in; the river was quiet."]
    pages = spark.createDataFrame([(i, x.format(*parts), "u", "clash", 1) for i, x in enumerate(LAYOUTS)], "page_id long, html string, url string, text string, n_chars long")
    got = page_content.main_text(pages, model, ["page_id", "url"]).collect()
    assert [r.text for r in sorted(got)] == ["\n\n".join(parts)] * 2


def test_awkward(spark, model):
    schema = "page_id long, url string, html string, text string, parents int"
    long = "<article><h1>Long</h1>" + "<p>one more sentence of this text, as said.</p>" * 20000 + "</article>"
    rows = [(1, None, None, "x", 1), (2, "u", "", None, None), (3, "u", "<p>", "x", 1), (None, "u", "<article><p>no id, but a text.</p></article>", "x", 1)]
    rows += [(4, "u", long, "x", 1), (5, "u", "a\x00b <>", "x", 1), (5, "u", "a\x00b <>", "x", 1)]
    got = page_content.main_text(spark.createDataFrame(rows, schema), model, ["page_id", "url"]).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r for r in got}
    assert by_id[1].text == by_id[2].text == by_id[3].text == "" and by_id[4].text.count("\n\n") == 20000
    assert page_content.main_text(spark.createDataFrame([], schema), model, ["page_id"]).count() == 0
