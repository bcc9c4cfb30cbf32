import html
import itertools
import math
import random
import re

import pytest

from hirelake.llm import html_text as H
from hirelake.llm.dom import Page, name_words
from hirelake.llm.labelled_pages import MARK, labelled_pages
from hirelake.llm.queries import QUERIES
from tests.llm.pages_by_hand import PAGES, page
from tests.llm.util import folder

MEDIUM = "/root/testdata/sf0.01"


def blocks(source):
    return [x for x in Page(source).text if x is not None]


def test_parsing():
    assert blocks("a<p>b &amp; c&nbsp;\n d</p>e<script>var x='</p>';</script>") == ["a", "b & c d", "e"]
    assert blocks("<p><b>x<br><p>y</p><li>1<li>2</ul>z") == ["x", "y", "1", "2", "z"]
    assert blocks('<div title="a > b">t</div><!-- <p>no</p> --><p>1 < 2 <3</p>') == ["t", "1 < 2 <3"]
    assert blocks("<P CLASS=x>u<EM>v</EM>w") == ["uvw"]
    assert blocks("text <b") == ["text"] and blocks("a < b") == ["a < b"] and blocks("") == []
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("<style>p{}</style><select><option>x<option>y</select><button>b</button>k") == ["x ybk"]
    assert name_words(' class="main-content postBody" id=top data-x="ad"') == ["main", "content", "post", "body", "top"]


def test_bad_markup_takes_linear_time():
    for s in ("<div>" * 50_000 + "x", "<a " * 50_000, '<a "' * 50_001, "<" * 100_000, "</p>" * 50_000, "<p>" * 50_000 + "y",
              "<script>" * 20_000, "<!--" * 50_000, "&amp" * 50_000, "<td>" * 50_000 + "z"):
        Page(s)


def test_only_raw_text_is_deleted_to_its_end_tag():
    for tag in ("svg", "math", "object", "audio", "video", "canvas", "map", "template", "noscript", "button", "select"):
        assert blocks(f"<div><p>a</p><{tag} id=x><p>b</p></div><p>c</p>") == ["a", "b", "c"], tag
        assert blocks(f"<p>a</p><{tag}-group>b</{tag}-group><p>c</p>") == ["a", "b", "c"], tag
        assert blocks(f"<div>a<{tag}>b</div><p>c</p><div>d <{tag}>e</{tag}> f</div>") == ["ab", "c", "d e f"], tag
    assert blocks("<p>a</p><svg class=x /><p>b</p><svg><path/></svg>c") == ["a", "b", "c"]
    assert blocks("<p>so <math><mi>x</mi></math> is <object>y</object></p>") == ["so x is y"]
    assert blocks("<p>a</p><script-x>b</script-x><style.x>c</style.x><title/>d</title><p>e") == ["a", "bc", "e"]
    # a self-closing or unclosed title inside an svg, and raw text without an end tag
    assert blocks("<svg><title/></svg><p>a</p><svg><title>b</title></svg>") == ["a"]
    assert blocks("<p>a</p><svg><title>b</svg><p>c</p><svg><title>d</title></svg>") == ["a", "b", "c"]
    assert blocks("<p>a</p><script x>b<p>c</p></scripts>") == ["a"]


def test_controls_keep_their_text():
    assert blocks("<p>a <button>b</button> c <select><option>d</select>e</p>") == ["a b c de"]
    assert blocks("<p>a</p><button>b<p>c</p><button>d</button><p>e") == ["a", "b", "c", "d", "e"]
    for s in ("<button>" * 50_000, "x<button>y</button>" * 50_000, "<svg><title></svg>" * 20_000 + "</title>",
              "<svg>" * 50_000 + "</math>" * 50_000, "<svg><title>" * 20_000, "<div><button></div>" * 30_000):
        Page(s)


def test_attributes_of_any_size_and_number():
    long = "{a > b} <p>no</p> " * 1000
    for q in "\"'":
        page = Page(f"<p>a</p><div data-x={q}{long}{q} class={q}main{q}>b</div><p>c</p>")
        assert [x for x in page.text if x] == ["a", "b", "c"]
        assert name_words(page.attrs[3]) == ["main"]
    many = " ".join(f'k{i}="> {i}"' for i in range(2000))
    assert blocks(f"<p {many}>a</p>") == ["a"] and blocks(f"<img {many}/>a") == ["a"]
    # quotes that open no value, or have no partner
    assert blocks("<p title=it's>a</p><p class='x'>b</p>") == ["a", "b"]
    assert blocks('<p title="x>a</p><p>b</p>') == ["a", "b"] and blocks("<p a = \n '>' b>c") == ["c"]
    for s in ('<a x=">"' * 50_000 + " y='", '<a x="' * 50_001, "<a x='" * 50_000 + '"', "<a/" * 50_000, "<a =" * 50_000,
              '<p x="' + ">" * 500_000, "<p " + "a='>' " * 100_000, '<a x=">"' * 50_000 + ">"):
        Page(s)


def test_sum_product_against_all_labelings():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 9)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        tables = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(n)]
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            e = sum(u for u, v in zip(unary, y) if v) + sum(tables[i][2 * y[parent[i]] + y[i]] for i in range(1, n))
            weight[y] = math.exp(e)
        total = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        assert H.sum_product(parent, unary, tables)[0] == pytest.approx(want)


def test_training_raises_the_likelihood_of_marked_pages():
    m = H.trained()
    good = bad = 0
    for s in labelled_pages(150, seed=99):  # other pages than those of the training
        want = [x.replace(MARK, "") for x in blocks(s) if MARK in x]
        got = H.main_blocks(s.replace(MARK, ""), m)
        good += sum(x in got for x in want)
        bad += sum(x not in got for x in want) + sum(x not in want for x in got)
    assert bad < 0.04 * good


def test_query_against_the_article_markup(spark):
    rows = {r.page_id: r for r in QUERIES["op8_html_text"](spark, MEDIUM).collect()}
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()
    wrong = 0
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        r = rows[p.page_id]
        wrong += r.text != "\n".join(x for x in parts if x)
        assert r.url == p.url and r.n_chars == len(r.text)
    assert len(rows) == len(pages) and wrong <= 0.01 * len(pages)


def test_pages_of_other_makes():
    page = """<html><body><div id="masthead"><a href="/">Home</a></div><div class="cookie-banner">We use cookies, please agree.</div>
    <div class="nav"><ul><li><a href="#">One</a></li><li><a href="#">Two</a></li></ul></div>
    <div class="post"><h1>The title of the post</h1><p>The first paragraph, which is long enough to read.</p>
    <p>The second one follows it. It has two sentences.</p></div>
    <div id="comments"><h3>Comments</h3><p>I do not agree with this, not at all.</p></div>
    <div class="footer">Copyright 2020, all rights reserved.</div></body></html>"""
    assert H.main_blocks(page, H.trained()) == [
        "The title of the post", "The first paragraph, which is long enough to read.",
        "The second one follows it. It has two sentences."]


def test_odd_rows(spark, tmp_path):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "v", "<p", 3), (4, "w", "<article><p>a b c.</p></article>", 4),
            (4, "w", "<article><p>a b c.</p></article>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = QUERIES["op8_html_text"](spark, folder(tmp_path, spark, pages=df)).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == [
        ("1", "u", "", 0), ("2", "None", "", 0), ("4", "w", "a b c.", 6), ("4", "w", "a b c.", 6), ("None", "v", "", 0)]
    assert H.extract_text(df.where("false")).count() == 0


def hand_figures(model):
    """Characters of content found, of all found, and of all content, over the hand-written pages."""
    found = right = want = 0
    for text in PAGES.values():
        source, content = page(text)
        wanted = [x for x in Page("\n".join(content)).text if x]
        left = list(H.main_blocks(source, model))
        found += sum(map(len, left))
        want += sum(map(len, wanted))
        for x in wanted:
            if x in left:
                left.remove(x)
                right += len(x)
    return right, found, want


def test_hand_written_pages_of_common_layouts():
    right, found, want = hand_figures(H.trained())
    assert right / want > 0.95 and right / found > 0.9, (right, found, want)
