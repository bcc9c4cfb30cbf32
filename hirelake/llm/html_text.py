"""Main text of web pages by a tree-structured graphical model.

Each block element and each text block of a page is a node that is content or
not. A node's potential is a sum of learned weights over its features (tag,
words in class, id and role; for text its length, link share, sentence marks).
Each edge from a parent to a child has a learned 2 x 2 table for the child's
group. Since the graph is the DOM tree, sum-product is exact: messages go up
from the leaves to the root and down again, and every node gets its marginal.
The text blocks with a content marginal of at least one half are the result.

The weights are trained by gradient ascent on the exact likelihood of labelled
pages (``labelled_pages``), with the expected counts from the same messages.

Plan: training pages are made and fitted on the driver (a fixed few hundred);
the pages are one scan without a shuffle, one row in, one row out.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import text_rows
from hirelake.llm.dom import Page, name_words
from hirelake.llm.labelled_pages import MARK, labelled_pages

PAGES, ROUNDS, RATE, DECAY = 300, 100, 0.15, 1e-5

#: groups of children that share a table
_GROUP = {"": "text", **dict.fromkeys("nav aside footer header form menu ul ol table fieldset dialog".split(), "side"),
          **dict.fromkeys("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody figure figcaption".split(), "part")}

# FIXED VALUES: words in class, id and role that the model has a weight for
CUES = frozenset("""article content post entry main story body text page wrapper container blog news
nav menu navbar header masthead banner logo top footer bottom copyright legal sidebar side widget rail aside right left
ad ads advert advertisement sponsor sponsored promo promotion adsbygoogle comment comments reply replies discussion
disqus respond reader cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup related
recommended more share social sharing breadcrumb breadcrumbs pagination pager tags meta form search login toolbar
complementary navigation contentinfo dialog""".split())


def _size(n: int) -> int:
    return 0 if n < 15 else 1 if n < 40 else 2 if n < 100 else 3 if n < 300 else 4


def text_features(text: str, linked: int, tag: str) -> tuple:
    n = len(text)
    stops = text.count(". ") + text.count(", ") + (text[-1] in ".!?")
    share = 0 if not linked else 1 if 2 * linked < n else 2
    return ("text", ("size", _size(n)), ("link", share), ("stops", min(3, stops)), ("in", tag),
            ("sign", any(c in text for c in "©|»›·")))


def element_features(tag: str, attrs: str) -> tuple:
    names = sorted({w for w in name_words(attrs) if w in CUES}) if attrs else ()
    return ("element", ("tag", tag), *(("name", w) for w in names)) if names else ("element", ("tag", tag), ("bare", tag))


def page_features(page: Page) -> list[tuple]:
    return [element_features(t, a) if x is None else text_features(x, k, page.tag[p])
            for t, a, x, k, p in zip(page.tag, page.attrs, page.text, page.linked, page.parent)]


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def sum_product(parent: list[int], unary: list[float], tables: list) -> tuple[list[float], list]:
    """Marginals by messages up and down the tree. ``unary`` is the log-odds
    of content of each node alone; ``tables[i]`` is the log table ``(00, 01,
    10, 11)`` of the edge to its parent (parent's label first). Parents come
    before children. Returns each node's content probability and, per node,
    the log-odds seen by the edge from below and from above."""
    n = len(parent)
    below, up = list(unary), [0.0] * n
    for i in range(n - 1, 0, -1):  # log-odds message to the parent
        t, x = tables[i], below[i]
        up[i] = _log_add(t[2], t[3] + x) - _log_add(t[0], t[1] + x)
        below[parent[i]] += up[i]
    belief, above = list(below), [0.0] * n
    for i in range(1, n):
        t, x = tables[i], belief[parent[i]] - up[i]
        above[i] = x
        belief[i] += _log_add(t[1], t[3] + x) - _log_add(t[0], t[2] + x)
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, b)))) for b in belief], [below, above]


class Model:
    """Weights of features and tables of edge groups."""

    def __init__(self):
        self.weights: dict = {}
        self.tables = {g: [0.5, -0.5, -0.5, 0.5] for g in ("text", "side", "part", "box")}

    def unary(self, features: tuple) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def edge(self, tag: str) -> list:
        return self.tables[_GROUP.get(tag, "box")]

    def marginals(self, page: Page, features: list[tuple]) -> tuple[list[float], list, list]:
        tables = [self.edge(t) for t in page.tag]
        p, seen = sum_product(page.parent, [self.unary(f) for f in features], tables)
        return p, seen, tables


def _labels(page: Page) -> list[int]:
    """Text blocks with the mark are content; an element is content if
    more than half of its text is."""
    n = len(page.tag)
    good, all_ = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if page.text[i] is not None:
            all_[i] = len(page.text[i])
            good[i] = all_[i] if MARK in page.text[i] else 0
        if i:
            good[page.parent[i]] += good[i]
            all_[page.parent[i]] += all_[i]
    return [int(2 * g > a) for g, a in zip(good, all_)]


def train(sources: list[str], rounds: int = ROUNDS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Gradient ascent on the mean log-likelihood of marked pages."""
    model, rows = Model(), []
    for s in sources:
        page = Page(s)
        y = _labels(page)
        page.text = [x if x is None else x.replace(MARK, "") or "x" for x in page.text]
        rows.append((page, page_features(page), y))
    scale: dict = {}
    for _, features, _ in rows:
        for f in features:
            for k in f:
                scale[k] = scale.get(k, 0) + 1
    total = sum(len(y) for _, _, y in rows) or 1
    first: dict = {}
    second: dict = {}
    for step in range(1, rounds + 1):
        grad, edges = dict.fromkeys(scale, 0.0), {g: [0.0] * 4 for g in model.tables}
        for page, features, y in rows:
            p, (below, above), tables = model.marginals(page, features)
            for f, yi, pi in zip(features, y, p):
                d = yi - pi
                for k in f:
                    grad[k] += d
            for i in range(1, len(y)):
                t, e = tables[i], edges[_GROUP.get(page.tag[i], "box")]
                e[2 * y[page.parent[i]] + y[i]] += 1
                cells = [t[0], t[1] + below[i], t[2] + above[i], t[3] + above[i] + below[i]]
                top = max(cells)
                w = [math.exp(c - top) for c in cells]
                for k in range(4):
                    e[k] -= w[k] / sum(w)
        # Adam: gradients over their running size, so that rare words learn as fast as common ones
        moves = [(model.weights, k, g) for k, g in grad.items()]
        moves += [(t, k, edges[g][k]) for g, t in model.tables.items() for k in range(4)]
        for place, k, g in moves:
            at = (id(place), k)
            old = place.get(k, 0.0) if isinstance(place, dict) else place[k]
            g = g / total - decay * old
            first[at] = 0.9 * first.get(at, 0.0) + 0.1 * g
            second[at] = 0.99 * second.get(at, 0.0) + 0.01 * g * g
            size = math.sqrt(second[at] / (1 - 0.99 ** step)) + 1e-8
            place[k] = old + rate * (1 - step / (rounds + 1)) * first[at] / (1 - 0.9 ** step) / size
    return model


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages(PAGES))


def main_blocks(source: str, model: Model) -> list[str]:
    """The content blocks of a page in page order."""
    page = Page(source)
    if len(page.tag) == 1:
        return []
    p, _, _ = model.marginals(page, page_features(page))
    return [x for x, q in zip(page.text, p) if x is not None and q >= 0.5]


def extract_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``.

    Cases: a null or empty page, and one without content, has an empty text;
    repeated rows and null ids or urls come back as they are; a page without
    markup is one text block; an empty table gives no rows; other columns are
    ignored.
    """
    spark = pages.sparkSession
    text_rows(spark)
    shared = spark.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            texts = ["\n".join(main_blocks(h, shared.value)) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.col("html").cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")
