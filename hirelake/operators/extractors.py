"""Extractors that users add (L2), and row generators for SQL (L4).

An extractor is a function of one page, ``fn(url, html) -> value``, registered
with the type of its value. ``extract`` runs any number of them in one Arrow
pass over the pages: the page crosses into Python once, every extractor gets
its own column, and what one of them raises becomes its error column for that
page and leaves the others alone.

The row generators are table functions for SQL: after ``register_generators``
``SELECT ... FROM pages p, LATERAL page_anchors(p.url, p.html)`` gives a row per
anchor, ``LATERAL page_jsonld(p.html)`` a row per JSON-LD item.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hirelake.operators.html import absolute, parse_page

Extractor = Callable[[str | None, str], object]

_REGISTERED: dict[str, tuple[Extractor, str]] = {}
_RESERVED = {"page_id", "url"}


def extractor(name: str, kind: str):
    """Register a function of a page under ``name``; ``kind`` is the value's type as DDL."""
    def register(fn: Extractor) -> Extractor:
        if name in _REGISTERED or name in _RESERVED or name.endswith("_error"):
            raise ValueError(f"extractor name {name!r} is taken")
        _REGISTERED[name] = (fn, kind)
        return fn
    return register


def registered() -> list[str]:
    return sorted(_REGISTERED)


def extract(pages: DataFrame, names: list[str], id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``(page_id, url, <name>, <name>_error, ...)`` for each page. A null page is
    an empty one; a repeated or unknown name is an error."""
    if unknown := [n for n in names if n not in _REGISTERED]:
        raise ValueError(f"no extractor {unknown}")
    if len(set(names)) < len(names):
        raise ValueError("an extractor is asked for twice")
    kind = pages.schema[id_col].dataType
    fields = [T.StructField("page_id", kind), T.StructField("url", T.StringType())]
    for n in names:
        fields += [T.StructField(n, T.DataType.fromDDL(_REGISTERED[n][1])), T.StructField(f"{n}_error", T.StringType())]
    schema = T.StructType(fields)
    chosen = [_REGISTERED[n][0] for n in names]  # the functions travel with the task
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for b in batches:
            urls, htmls = b.column(1).to_pylist(), b.column(2).to_pylist()
            cols = [b.column(0), b.column(1)]
            for fn, value_type in zip(chosen, types[2::2]):
                values, errors = [], []
                for url, html in zip(urls, htmls):
                    value = error = None
                    try:
                        value = fn(url, html or "")
                        pa.array([value], value_type)  # a value of another type is the extractor's error too
                    except Exception as e:
                        value, error = None, f"{type(e).__name__}: {e}"
                    values.append(value)
                    errors.append(error)
                cols += [pa.array(values, value_type), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------- extractors that come with the package

@extractor("heading", "string")
def heading(url: str | None, html: str) -> str | None:
    """The text of the first ``h1``."""
    m = re.search(r"(?is)<h1\b[^>]*>(.*?)</h1>", html)
    return re.sub(r"(?s)<[^>]*>", "", m.group(1)).strip() if m else None


@extractor("links", "struct<n:int,inside:int,hosts:array<string>>")
def links(url: str | None, html: str) -> dict:
    """Anchors of a page: how many, how many that stay on its host, and the other hosts."""
    host = re.compile(r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)")
    own = host.match(url or "")
    to = [absolute(url, a["href"]) or a["href"] for a in parse_page(html)["anchors"]]
    hosts = [m.group(1) for m in map(host.match, to) if m]
    other = [h for h in hosts if not own or h != own.group(1)]
    return {"n": len(to), "inside": len(hosts) - len(other), "hosts": sorted(set(other))}


# ---------------------------------------------------------------- row generators

class PageAnchors:
    """``(pos, href, abs_url, text)`` of each anchor of a page, in order."""

    def eval(self, url: str, html: str):
        for a in parse_page(html)["anchors"]:
            yield a["pos"], a["href"], absolute(url, a["href"]), a["text"]


class PageJsonLd:
    """``(pos, item_type, title, item)`` of the JSON-LD objects of a page: a
    script's object, or the objects of its ``@graph``."""

    def eval(self, html: str):
        pos = 0
        for script in parse_page(html)["ld_json"]:
            try:
                top = json.loads(script)
            except ValueError:
                continue
            if not isinstance(top, dict):
                continue
            graph = top.get("@graph") if "@type" not in top else None
            for item in graph if isinstance(graph, list) else [top]:
                if isinstance(item, dict):
                    kind, title = item.get("@type"), item.get("title")
                    yield (pos, kind if isinstance(kind, str) else None, title if isinstance(title, str) else None,
                           json.dumps(item))
                    pos += 1


def register_generators(spark: SparkSession) -> None:
    """``page_anchors(url, html)`` and ``page_jsonld(html)`` for the session's SQL."""
    spark.udtf.register("page_anchors", F.udtf(
        PageAnchors, returnType="pos int, href string, abs_url string, text string", useArrow=True))
    spark.udtf.register("page_jsonld", F.udtf(
        PageJsonLd, returnType="pos int, item_type string, title string, item string", useArrow=True))
