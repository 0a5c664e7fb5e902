"""Main text of pages: minimum cuts against all labellings, pages of known text, and time that grows with the page."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from tessella.llm import extraction, queries

P = "This is a sentence of the article with many words, which goes on for a while and says something. It has another sentence too."
#: html, text
PAGES = [
    (f"<html><head><title>T</title><body><div id=header><h1>Site</h1></div><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div id=content><h1>Title</h1><p>{P}<p>Short.<p>{P}</div><div id=sidebar>Links <a href=3>x</a></div><div id=footer>Copyright 2020</div>", f"Title {P} Short. {P}"),
    (f"<header><h1>Site</h1><p>tag line</p></header><main><article><header><h1>Title</h1></header><p>{P}</p><aside>See also</aside><p>{P}</p><footer>Tags</footer></article><section id=comments><article class=comment><p>{P}</p></article></section></main><footer>x</footer>", f"Title {P} {P}"),
    (f"<div><ul><li><a href=1>Home</a><li><a href=2>About</a></ul></div><div><h1>Title</h1><p>{P}</p><p>Yes.</p><ul><li>{P}</li></ul><p>{P}</p></div><div>Copyright <a href=x>me</a></div>", f"Title {P} Yes. {P} {P}"),
    (f'<div class="cookie-notice">{P}</div><form action=x><input name=q><label>Search</label></form><article><h2>A &amp; B</h2><p>{P} 1 &lt; 2 <a href="x>y">link</a>s</p><div class="ad">{P}</div><table><tr><td>a<td>b</table></article>', f"A & B {P} 1 < 2 links a b"),
    (f'<article><p>{P}</p><p hidden>{P}</p><p style="display: none">{P}</p><div class="share-bar"><a>t</a></div></article><div class="userComments"><p>{P}</p></div><script>var a = "<p>";</script>', P),
    (f"<article><p>a&nbsp;\n\t b<br>c&#233;<b>d</b>e<!-- no --></p><style>p</style>{P}<noscript>{P}</noscript></article>", f"a b cédede {P}".replace("dede", "de")),
    ("<article><svg><path d='x'/><text>no</text></svg>yes<textarea>no</textarea><select><option>no</select></article>", "yes"),
    (None, ""), ("", ""), ("<", ""), ("<a", ""), ("<a b='", ""), ("<!--", ""), ("<script>x", ""), ("<nav>only a menu</nav>", ""), (f"<nav><article>{P}</article></nav>", ""),
    (f'<div class="page has-sidebar"><div class="content with-sidebar"><h1>T</h1><p>{P}</p></div><div class="sidebar"><p>{P}</p></div></div>', f"T {P}"),
    (f'<div id="content-sidebar-wrap"><div><h1>T</h1><p>{P}</p><p>{P}</p><div class="adsbygoogle">{P}</div></div></div>', f"T {P} {P}"),
    (f'<div role="banner"><p>{P}</p></div><div class="entry"><div class="entry-header"><h1>T</h1></div><p>{P}</p><div class="ad-container"><p>{P}</p></div><div class="entry-footer"><p>{P}</p></div></div><div id="disqus_thread"><p>{P}</p></div>', f"T {P}"),
    (f'<article><h1>T</h1><p>{P}</p><div class="newsletter-signup"><p>{P}</p></div><blockquote>{P}</blockquote><pre>a  b\n c</pre></article><div class="alert alert-info"><p>{P}</p></div><ol class="commentlist"><li><p>{P}</p></li></ol>', f"T {P} {P} a b c"),
    (f"<p class='{'x' * 9000}'>{P}", P), (f"<div class=post>{P}<p title='a>b' alt=\">\">{P}</div>", f"{P} {P}"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_known_pages(html, text):
    assert extraction.main_text(html, extraction.PRIOR) == text


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        lean = [rng.choice((-3, -1, -0.5, 0, 0.5, 1, 3)) * rng.random() for _ in range(n)]
        edges = [(a, b, 2 * rng.random()) for a in range(n) for b in range(a) if rng.random() < 0.5] + [(0, 0, 1.0)]

        def cost(side, lean=lean, edges=edges):
            own = sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(lean, side, strict=True))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        got = extraction.minimum_cut(lean, edges)
        least = min(cost(s) for s in itertools.product((False, True), repeat=n))
        assert abs(cost(got) - least) < 1e-9


def test_even_nodes_go_to_the_sink():
    assert extraction.minimum_cut([0.0, 0.0], [(0, 1, 1.0)]) == [False, False]
    assert extraction.minimum_cut([0.4, -0.1], [(0, 1, 1.0)]) == [True, True]
    assert extraction.minimum_cut([], []) == []


@pytest.mark.parametrize(
    "html",
    ['<a b="' * 100_000, "<" * 300_000, "<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>x" * 20_000, "<!-- " * 100_000, "<ul><li>x" * 20_000, "<td>x" * 50_000, "<script>" * 50_000, "<a b='\"'>" * 50_000,
     "<div>a b c<span>, d</span></div>" * 20_000, "<div><a href=x>a b</a></div><p>word word, word word word word.</p>" * 10_000, "&" * 300_000, "<a b='>" * 60_000 + "'"],
)
def test_time_grows_with_the_page(html):
    began = time.process_time()
    extraction.main_text(html, extraction.PRIOR)
    assert time.process_time() - began < 10


def article_pages(n, seed):
    """Pages of one shape and what they say."""
    rng = random.Random(seed)
    said = lambda k: " ".join(rng.choice("the of and a tion er anble thst".split()) for _ in range(k)) + "."
    out = []
    for k in range(n):
        parts = [said(rng.randint(8, 60)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in parts)
        html = f"<nav><ul>{''.join(f'<li><a href=x>{said(1)}</a></li>' for _ in range(5))}</ul></nav><article><h1>{parts[0]}</h1>{body}</article><footer>{said(4)}</footer>"
        out.append((k, f"http://h{k % 7}.example/{k}", html, " ".join([parts[0], *parts])))
    return out


def test_model_is_fitted_and_holds_on_other_pages(spark):
    rows = article_pages(120, 1)
    df = spark.createDataFrame([(*r[:3], "n", "t") for r in rows], "page_id long, url string, html string, n_chars string, text string")
    weights = extraction.fit(df)
    assert weights.shape == (extraction.WIDTH,) and not np.array_equal(weights, extraction.PRIOR)
    assert np.allclose(weights, extraction.fit(df.repartition(5)))
    assert all(extraction.main_text(html, weights) == text for _, _, html, text in article_pages(60, 2))
    bare = [(h.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>"), t) for _, _, h, t in article_pages(60, 3)]
    right = sum(text in extraction.main_text(html, weights) for html, text in bare)
    assert right >= 57
    got = extraction.extract(df, weights).collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got) == sorted((i, u, t, len(t)) for i, u, _, t in rows)


def test_model_of_a_part_of_the_pages(spark):
    df = spark.createDataFrame([r[:3] for r in article_pages(300, 5)], "page_id long, url string, html string")
    assert extraction.fit(df, fitted=100).shape == (extraction.WIDTH,)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, None, ""), (1, None, ""), (None, "u", "<p>")]])
def test_rows_without_text(spark, rows):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    got = extraction.extract(df, extraction.fit(df)).collect()
    assert len(got) == len(rows) and all(r.text == "" and r.n_chars == 0 for r in got)


def test_query(spark, small_dir):
    import html
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    out = queries.op12_extraction(spark, small_dir).collect()
    assert len(out) == len(rows)
    for r in out:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", rows[r.page_id], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(?:p|/p|h1|/h1|br)>", " ", inner))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)
