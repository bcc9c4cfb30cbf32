"""Bulk HTML extraction over a ``pages(page_id, url, html)`` table.

The only Python step is ``extract_pages``: one ``mapInArrow`` task per
partition runs the standard-library ``html.parser`` once per page and emits a
compact struct — anchors, JSON-LD script texts, the first element text of
every heuristic selector, and the visible text. Everything after that
(URL resolution, link filters, JSON-LD field access via VARIANT, selector
validation, text cleaning, the parse cascade) is native Column code.

Tree rules follow the source's parser stack: an end tag pops to the nearest
open element of that name (unmatched end tags are ignored), void elements
never stay open, nothing is closed implicitly. Element text is the
concatenation of its text nodes, each stripped, with no separator; text of
script/style/template and comments never counts.
"""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions import predicates as P
from hirelake.functions import rules
from hirelake.functions import scalars as S

# FIXED VALUES: elements that never have content (stay closed after the start tag)
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
    "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
    "nextid", "spacer",
])
# FIXED VALUES: elements whose text is not ordinary text
STRING_CONTAINER_TAGS = frozenset(["script", "style", "template"])

SELECTOR_GROUPS = {
    "title": rules.TITLE_SELECTORS,
    "company": rules.COMPANY_SELECTORS,
    "location": rules.LOCATION_SELECTORS,
    "description": rules.DESCRIPTION_SELECTORS,
}
_FLAT_SELECTORS = [(g, i, sel) for g, sels in SELECTOR_GROUPS.items() for i, sel in enumerate(sels)]
# selectors indexed by the attribute they test (None: tag-only), so a start tag
# only tries the selectors that can apply to it
_BY_ATTR: dict = {}
for _g, _i, _sel in _FLAT_SELECTORS:
    _BY_ATTR.setdefault(_sel[1], []).append(((_g, _i), _sel))

EXTRACT_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("anchors", T.ArrayType(T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("href", T.StringType()),
        T.StructField("abs_url", T.StringType()), T.StructField("text", T.StringType())]))),
    T.StructField("ld_json", T.ArrayType(T.StringType())),
    T.StructField("title_cands", T.ArrayType(T.StringType())),
    T.StructField("company_cands", T.ArrayType(T.StringType())),
    T.StructField("location_cands", T.ArrayType(T.StringType())),
    T.StructField("description_cands", T.ArrayType(T.StringType())),
    T.StructField("visible_text", T.StringType()),
    T.StructField("parse_error", T.StringType()),
])


def _matches(sel, tag: str, attrs: dict) -> bool:
    want_tag, attr, op, value = sel
    if want_tag is not None and tag != want_tag:
        return False
    if attr is None:
        return True
    if attr not in attrs:
        return False
    got = attrs[attr] or ""
    if attr == "class":
        got = " ".join(got.split())
    return (value in got) if op == "*=" else (got == value)


class _PageParser(HTMLParser):
    """Event-driven single pass; keeps only what the extraction needs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[int] = []          # open element ids
        self.tags: list[str] = []           # element id -> tag
        self.span: list[list[int]] = []     # element id -> [text_start, text_end]
        self.texts: list[str] = []          # stripped ordinary text nodes
        self.visible: list[str] = []        # raw ordinary text outside hidden subtrees
        self.buf: list[str] = []
        self.container_depth = 0
        self.hidden_depth = 0
        self.anchors: list[tuple[int, str]] = []   # (element id, href)
        self.ld: list[tuple[int, list[str]]] = []  # (element id, script text parts)
        self.meta_content: dict[int, str] = {}
        self.first: dict[tuple[str, int], int] = {}

    # -- text
    def handle_data(self, data):
        self.buf.append(data)

    def _flush(self):
        if not self.buf:
            return
        s = "".join(self.buf)
        self.buf = []
        if self.container_depth:
            if self.ld and self.stack and self.ld[-1][0] == self.stack[-1]:
                self.ld[-1][1].append(s)
            return
        piece = s.strip()
        if piece:
            self.texts.append(piece)
        if not self.hidden_depth:
            self.visible.append(s)

    # -- tags
    def handle_starttag(self, tag, attrs):
        self._flush()
        a = {}
        for k, v in attrs:
            a[k] = "" if v is None else v
        eid = len(self.tags)
        self.tags.append(tag)
        self.span.append([len(self.texts), -1])
        first = self.first
        for key, sel in _BY_ATTR[None]:
            if key not in first and sel[0] == tag:
                first[key] = eid
        for attr in a:
            for key, sel in _BY_ATTR.get(attr, ()):
                if key not in first and _matches(sel, tag, a):
                    first[key] = eid
        if tag == "a" and "href" in a:
            self.anchors.append((eid, a["href"]))
        if tag == "meta":
            self.meta_content[eid] = a.get("content", "")
        if tag == "script" and a.get("type") == "application/ld+json":
            self.ld.append((eid, []))
        if tag in VOID_TAGS:
            self.span[eid][1] = len(self.texts)
            return
        self.stack.append(eid)
        if tag in STRING_CONTAINER_TAGS:
            self.container_depth += 1
        if tag in rules.NON_VISIBLE_TAGS:
            self.hidden_depth += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.tags[self.stack[k]] == tag:
                for eid in self.stack[k:]:
                    self._close(eid)
                del self.stack[k:]
                return

    def _close(self, eid):
        self.span[eid][1] = len(self.texts)
        t = self.tags[eid]
        if t in STRING_CONTAINER_TAGS:
            self.container_depth -= 1
        if t in rules.NON_VISIBLE_TAGS:
            self.hidden_depth -= 1

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def finish(self):
        self.close()
        self._flush()
        for eid in self.stack:
            self.span[eid][1] = len(self.texts)
        self.stack = []

    def text_of(self, eid: int) -> str:
        s, e = self.span[eid]
        return "".join(self.texts[s:e])


def parse_page(html: str | None) -> dict:
    """Extraction of one page (plain Python; used by the Arrow task and tests)."""
    p, error = _PageParser(), None
    try:
        p.feed(html or "")
        p.finish()
    except (AssertionError, ValueError, IndexError) as e:  # beyond the tokenizer's tolerance: keep what was seen, and say so
        error = f"{type(e).__name__}: {e}"
        p._flush()
        for eid in p.stack:
            if p.span[eid][1] < 0:
                p.span[eid][1] = len(p.texts)
    out = {
        "anchors": [{"pos": i, "href": href, "text": p.text_of(eid)} for i, (eid, href) in enumerate(p.anchors)],
        "ld_json": [("".join(parts) if parts else None) for _, parts in p.ld],
        "visible_text": "".join(p.visible),
        "parse_error": error,
    }
    for g, sels in SELECTOR_GROUPS.items():
        cands = []
        for i, sel in enumerate(sels):
            eid = p.first.get((g, i))
            if eid is None:
                cands.append(None)
            elif sel[0] == "meta":
                cands.append(p.meta_content.get(eid, ""))
            else:
                cands.append(p.text_of(eid))
        out[f"{g}_cands"] = cands
    return out


def absolute(base: str | None, href: str) -> str | None:
    """H4: ``href`` as the page at ``base`` means it; a reference that no URL
    can be made of stays as it is."""
    if base is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def _extract_batches(batches):
    arrow_schema = None
    for batch in batches:
        arrow_schema = arrow_schema or pa.schema([
            ("page_id", batch.column("page_id").type), ("url", pa.string()),
            ("anchors", pa.list_(pa.struct([
                ("pos", pa.int32()), ("href", pa.string()), ("abs_url", pa.string()), ("text", pa.string())]))),
            ("ld_json", pa.list_(pa.string())),
            ("title_cands", pa.list_(pa.string())), ("company_cands", pa.list_(pa.string())),
            ("location_cands", pa.list_(pa.string())), ("description_cands", pa.list_(pa.string())),
            ("visible_text", pa.string()), ("parse_error", pa.string()),
        ])
        ids = batch.column("page_id").to_pylist()
        urls = batch.column("url").to_pylist()
        htmls = batch.column("html").to_pylist()
        cols = {k: [] for k in arrow_schema.names}
        for pid, url, html in zip(ids, urls, htmls):
            r = parse_page(html)
            resolved = {h: absolute(url, h) for h in {a["href"] for a in r["anchors"]}}
            for a in r["anchors"]:
                a["abs_url"] = resolved[a["href"]]
            cols["page_id"].append(pid)
            cols["url"].append(url)
            for k in ("anchors", "ld_json", "title_cands", "company_cands", "location_cands",
                      "description_cands", "visible_text", "parse_error"):
                cols[k].append(r[k])
        yield pa.RecordBatch.from_pydict(cols, schema=arrow_schema)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One parse per page -> anchors, JSON-LD texts, selector
    candidates, visible text, and why a page was parsed in part only (null
    otherwise). Only the three input columns cross into Python. A text id
    (the raw-page table's hash) stays text, a number becomes a bigint."""
    text_id = isinstance(pages.schema[id_col].dataType, T.StringType)
    kind = T.StringType() if text_id else T.LongType()
    src = pages.select(F.col(id_col).cast(kind).alias("page_id"), F.col(url_col).alias("url"),
                       F.col(html_col).alias("html"))
    schema = T.StructType([T.StructField("page_id", kind), *EXTRACT_SCHEMA.fields[1:]])
    return src.mapInArrow(_extract_batches, schema)


# ---------------------------------------------------------------- anchors and job links

def anchors(extracted: DataFrame) -> DataFrame:
    """``(page_id, pos, href, abs_url, text)``, one row per anchor with an
    ``href``, in document order."""
    return extracted.select("page_id", F.inline("anchors")).select("page_id", "pos", "href", "abs_url", "text")


def _accepted(extracted: DataFrame) -> DataFrame:
    """``(page_id, page_url, url, title, pos)`` of the first accepted anchor
    per page and URL. The anchors become rows before the filter, so that it is
    compiled; only accepted ones are shuffled, once, by page."""
    a = extracted.select("page_id", F.col("url").alias("page_url"), F.inline("anchors")).filter(
        (F.col("href") != "") & P.job_link_ok(F.col("page_url"), F.col("abs_url"), F.col("text")))
    first = F.min(F.struct("pos", F.col("text").alias("title"), "page_url"))
    rows = a.repartition("page_id").groupBy("page_id", F.col("abs_url").alias("url")).agg(first.alias("__a"))
    return rows.select("page_id", "__a.page_url", "url", "__a.title", "__a.pos")


def job_links(extracted: DataFrame) -> DataFrame:
    """Anchors -> absolute URL -> http / same host / not generic / job
    URL with an id / title length -> first accepted anchor per (page, URL)."""
    return _accepted(extracted).select("page_id", "url", "title", "pos")


def numbered_job_links(extracted: DataFrame, first: int | None = None) -> DataFrame:
    """I2/E5 in page order: ``(page_id, page_url, pos, url, title)`` with ``pos``
    counted from 0 over a page's job links, the ``first`` of them if given."""
    w = Window.partitionBy("page_id").orderBy("pos")  # a page's links
    rows = _accepted(extracted).withColumn("pos", F.row_number().over(w) - 1)
    rows = rows if first is None else rows.filter(F.col("pos") < first)
    return rows.select("page_id", "page_url", "pos", "url", "title")


# ---------------------------------------------------------------- JSON-LD

def _vget(v: Column, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(v, path, typ)


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_obj(v: Column) -> Column:
    return F.coalesce(_vtype(v).startswith("OBJECT"), F.lit(False))


def _thousands(v: Column) -> Column:
    """Python ``f"{x:,}"`` of a JSON number."""
    s = F.try_variant_get(v, "$", "string")
    ip = F.regexp_extract(s, r"^(-?[0-9]+)", 1)
    frac = F.regexp_extract(s, r"(\.[0-9]+)$", 1)
    return F.concat(F.call_function("format_number", ip.cast("long"), F.lit("#,###")), frac)


def _graph_candidates(v: Column) -> Column:
    """Candidates of one parsed script, in order: the object itself when it is
    a posting, else the items of its ``@graph`` (a non-object item, or a
    non-list non-empty ``@graph``, is an error when reached)."""
    cand_t = "array<struct<item:variant,hit:boolean,bad:boolean>>"
    top = F.coalesce(_vget(v, '$["@type"]', "string") == "JobPosting", F.lit(False))
    g_raw = _vget(v, '$["@graph"]')
    g_arr = _vget(v, '$["@graph"]', "array<variant>")
    g_empty = F.coalesce(_vtype(g_raw).isin("OBJECT<>") | (_vtype(g_raw) == "STRING")
                         & (F.try_variant_get(g_raw, "$", "string") == ""), F.lit(False))
    items = F.transform(g_arr, lambda it: F.struct(
        it.alias("item"),
        (_is_obj(it) & F.coalesce(_vget(it, '$["@type"]', "string") == "JobPosting", F.lit(False))).alias("hit"),
        (~_is_obj(it)).alias("bad")))
    bad_graph = F.array(F.struct(g_raw.alias("item"), F.lit(False).alias("hit"), F.lit(True).alias("bad")))
    empty = F.array().cast(cand_t)
    return (F.when(top, F.array(F.struct(v.alias("item"), F.lit(True).alias("hit"), F.lit(False).alias("bad"))))
            .when(g_raw.isNull(), empty)
            .when(g_arr.isNotNull(), items)
            .when(g_empty, empty)
            .otherwise(bad_graph))


_JL_FIELDS = ["title", "description", "company", "location", "salary", "job_type"]


def _t_is_obj(t: Column) -> Column:
    return F.coalesce(t.startswith("OBJECT"), F.lit(False))


def _t_is_num(t: Column) -> Column:
    return F.coalesce(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"),
                      F.lit(False))


def _c_text(v: Column, t: Column) -> Column:
    """``_py_text`` over a staged value column and its staged type column."""
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull(), F.lit(None).cast("string")).when(t == "VOID", F.lit("None"))
            .when(t == "BOOLEAN", F.when(s == "true", F.lit("True")).otherwise(F.lit("False")))
            .otherwise(s))


def _c_truthy(v: Column, t: Column) -> Column:
    s = F.try_variant_get(v, "$", "string")
    return (F.when(v.isNull() | (t == "VOID"), F.lit(False))
            .when(_t_is_num(t), F.try_variant_get(v, "$", "double") != 0)
            .when(t == "STRING", s != "").when(t == "BOOLEAN", s == "true")
            .when(t.startswith("ARRAY"), F.coalesce(F.array_size(F.try_variant_get(v, "$", "array<variant>")) > 0,
                                                    F.lit(False)))
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.lit(True)))


def _with_jsonld(extracted: DataFrame) -> DataFrame:
    """Adds ``jsonld_status`` (NULL: no hit, ``ok`` or ``error``) and ``jl_*``
    fields to every row. The first hit is picked per row with array
    functions (no explode, no shuffle): all candidates of a page come from
    that page's own row. Each JSON path and its type is extracted once into a
    staged column; the field rules then read those columns."""
    parsed = F.filter(F.transform(F.col("ld_json"), lambda t: F.try_parse_json(t)), lambda v: _is_obj(v))
    cands = F.flatten(F.transform(parsed, _graph_candidates))
    first_c = F.get(F.filter(cands, lambda c: c["hit"] | c["bad"]), 0)
    x = extracted.withColumn("__c", first_c)
    it = F.col("__c.item")
    # every path is read straight from the item (a path through a non-object is NULL)
    paths = {"tv": "$.title", "dv": "$.description", "org": "$.hiringOrganization", "loc": "$.jobLocation",
             "bs": "$.baseSalary", "val": "$.baseSalary.value", "et": "$.employmentType",
             "orgn": "$.hiringOrganization.name", "addr": "$.jobLocation.address",
             "mn": "$.baseSalary.value.minValue", "mx": "$.baseSalary.value.maxValue",
             "cur": "$.baseSalary.value.currency", "city": "$.jobLocation.address.addressLocality",
             "region": "$.jobLocation.address.addressRegion", "locname": "$.jobLocation.name"}
    x = x.select("*", *[_vget(it, p_).alias(f"__{k}") for k, p_ in paths.items()])
    typed = list(paths)
    x = x.select("*", *[_vtype(F.col(f"__{k}")).alias(f"__t_{k}") for k in typed])

    def v(k):
        return F.col(f"__{k}")

    def t(k):
        return F.col(f"__t_{k}")

    # the output model only takes text: a non-text organisation name, location
    # name or employment type makes the hit unusable (an error), as in the source
    company = (F.when(v("org").isNull(), F.lit(""))
               .when(_t_is_obj(t("org")), F.when(v("orgn").isNull(), F.lit(""))
                     .when(t("orgn") == "STRING", F.try_variant_get(v("orgn"), "$", "string")))
               .otherwise(_c_text(v("org"), t("org"))))
    joined = F.regexp_replace(F.concat(F.coalesce(_c_text(v("city"), t("city")), F.lit("")), F.lit(", "),
                                       F.coalesce(_c_text(v("region"), t("region")), F.lit(""))), r"^[, ]+|[, ]+$", "")
    by_name = F.when(t("locname") == "STRING", F.try_variant_get(v("locname"), "$", "string"))
    use_name = _t_is_obj(t("loc")) & v("addr").isNotNull() & ~_t_is_obj(t("addr"))
    location = (F.when(v("loc").isNull(), F.lit(""))
                .when(_t_is_obj(t("loc")), F.when(use_name, by_name).otherwise(joined))
                .otherwise(F.lit(None).cast("string")))
    loc_err = use_name & v("locname").isNotNull() & (t("locname") != "VOID") & (t("locname") != "STRING")
    currency = F.when(v("cur").isNull(), F.lit("USD")).otherwise(_c_text(v("cur"), t("cur")))
    sal_ok = _t_is_obj(t("bs")) & _t_is_obj(t("val")) & _c_truthy(v("mn"), t("mn")) & _c_truthy(v("mx"), t("mx"))
    nums = _t_is_num(t("mn")) & _t_is_num(t("mx"))
    salary = F.when(sal_ok & nums, F.concat(F.lit("$"), _thousands(v("mn")), F.lit(" - $"), _thousands(v("mx")),
                                            F.lit(" "), currency))
    et_first = F.try_variant_get(v("et"), "$[0]", "variant")
    et_first_t = _vtype(et_first)
    et_is_arr = F.coalesce(t("et").startswith("ARRAY"), F.lit(False))
    job_type = (F.when(v("et").isNull(), F.lit(""))
                .when(et_is_arr, F.when(et_first.isNull(), F.lit(""))
                      .otherwise(F.try_variant_get(et_first, "$", "string")))
                .otherwise(F.try_variant_get(v("et"), "$", "string")))
    jt_err = (F.when(et_is_arr, et_first.isNotNull() & ~et_first_t.isin("STRING", "VOID"))
              .otherwise(v("et").isNotNull() & ~t("et").isin("STRING", "VOID")))
    title = F.when(v("tv").isNull(), F.lit("")).otherwise(
        F.when(t("tv") == "STRING", F.try_variant_get(v("tv"), "$", "string")))
    desc = F.when(v("dv").isNull(), F.lit("")).otherwise(
        F.when(t("dv") == "STRING", F.try_variant_get(v("dv"), "$", "string")))
    vals = dict(zip(_JL_FIELDS, [title, desc, company, location, salary, job_type]))
    x = x.select("*", *[c.alias(f"__f_{k}") for k, c in vals.items()],
                 ((sal_ok & ~nums) | F.coalesce(loc_err, F.lit(False)) | F.coalesce(jt_err, F.lit(False)))
                 .alias("__field_err"))
    error = (F.col("__c.bad") | F.col("__f_title").isNull() | F.col("__f_description").isNull()
             | F.col("__f_company").isNull() | F.col("__field_err"))
    x = x.withColumn("jsonld_status", F.when(F.col("__c").isNull(), F.lit(None).cast("string"))
                     .when(error, F.lit("error")).otherwise(F.lit("ok")))
    x = x.select("*", *[F.when(F.col("jsonld_status") == "ok", F.col(f"__f_{k}")).alias(f"jl_{k}") for k in _JL_FIELDS])
    temps = [c for c in x.columns if c.startswith("__")]
    return x.drop(*temps)


def jsonld_postings(extracted: DataFrame) -> DataFrame:
    """First schema.org posting per page, in (script, graph item) order.

    Output per page with at least one hit: ``jsonld_status`` is ``ok`` or
    ``error`` (unusable hit: null/non-text title or description, null
    organisation name, text salary bounds, or a non-object graph item met
    before the hit) plus the posting fields. Pages without a hit are absent.
    """
    x = _with_jsonld(extracted)
    row = F.struct(F.col("page_id"), F.col("jsonld_status"), *[F.col(f"jl_{k}").alias(k) for k in _JL_FIELDS])
    # a 0-or-1 element inline keeps pages with a hit without a pushed-down
    # filter, which would evaluate the JSON-LD expressions twice
    one = F.when(F.col("jsonld_status").isNotNull(), F.array(row)).otherwise(F.array().cast(T.ArrayType(row_type())))
    return x.select(F.inline(one))


def row_type():
    return T.StructType([T.StructField("page_id", T.LongType()), T.StructField("jsonld_status", T.StringType())]
                        + [T.StructField(k, T.StringType()) for k in _JL_FIELDS])


# ---------------------------------------------------------------- heuristics (I4, T11) and cascade

def _last_non_null(arr: Column) -> Column:
    kept = F.filter(arr, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.element_at(kept, -1))


def _heuristic_columns(max_description: int | None = None) -> dict:
    """I4 columns: title (first valid candidate, else reject), company (first
    valid, else the last matched text, else from the URL), location (first
    valid), description (first longer than 100, of which ``max_description``
    characters if a limit is given, else the last matched text, which must
    still be at least 100)."""
    tc = F.col("title_cands")
    title = F.get(F.filter(tc, lambda t: t.isNotNull() & P.valid_title(t)), 0)
    cc = F.col("company_cands")
    comp_valid = F.get(F.filter(cc, lambda t: t.isNotNull() & P.valid_company(t)), 0)
    company = F.coalesce(comp_valid, _last_non_null(cc))
    company = F.when(F.coalesce(company, F.lit("")) == "", S.company_from_url("url")).otherwise(company)
    location = F.get(F.filter(F.col("location_cands"), lambda t: t.isNotNull() & P.valid_location(t)), 0)
    dc = F.col("description_cands")
    long_desc = F.get(F.filter(dc, lambda t: t.isNotNull() & (F.length(t) > 100)), 0)
    long_desc = long_desc if max_description is None else F.substring(long_desc, 1, max_description)
    desc = F.coalesce(long_desc, _last_non_null(dc))
    reason = (F.when(title.isNull(), F.lit("no_valid_title"))
              .when(~P.valid_description(desc), F.lit("short_description")))
    return {"title": title, "description": desc, "company": company, "location": location, "reject_reason": reason}


def heuristics(extracted: DataFrame) -> DataFrame:
    """I4: selector heuristics per page (see ``_heuristic_columns``)."""
    cols = _heuristic_columns()
    return extracted.select("page_id", "url", *[c.alias(k) for k, c in cols.items()])


def parse_cascade(extracted: DataFrame) -> DataFrame:
    """JSON-LD hit first (even an unusable one ends the cascade), else
    heuristics, else reject. Failures are kept as rows with a reason. Both
    strategies are columns of one projection over the single parse."""
    x = _with_jsonld(extracted)
    h = {f"h_{k}": c for k, c in _heuristic_columns().items()}
    x = x.select("page_id", "url", "jsonld_status", *[F.col(f"jl_{k}") for k in _JL_FIELDS],
                 *[c.alias(k) for k, c in h.items()])
    st = F.col("jsonld_status")
    strategy = (F.when(st == "ok", F.lit("jsonld")).when(st == "error", F.lit("error"))
                .when(F.col("h_reject_reason").isNull(), F.lit("heuristics")).otherwise(F.lit("reject")))
    use_h = st.isNull() & F.col("h_reject_reason").isNull()

    # JSON-LD fields when the hit was usable; heuristic fields only when there was no hit
    out = [F.coalesce(F.col(f"jl_{k}"), F.when(use_h, F.col(f"h_{k}"))).alias(k)
           if f"h_{k}" in h else F.col(f"jl_{k}").alias(k) for k in _JL_FIELDS]
    return x.select("page_id", "url", strategy.alias("parse_strategy"), *out,
                    F.when(st == "error", F.lit("jsonld_unusable"))
                    .when(st.isNull(), F.col("h_reject_reason")).alias("reject_reason"))


def page_text(extracted: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Visible text (script/style/nav/header/footer dropped), cleaned."""
    return extracted.select("page_id", S.clean_text("visible_text", max_chars).alias("text"))


# ---------------------------------------------------------------- posting normaliser

def normalise_postings(parsed: DataFrame, page_url: str = "url", crawled_at=None, epoch: int = 0,
                       company_name=None, batch_url: str | None = None, batch_pos: str | None = None) -> DataFrame:
    """A4/A5: parsed postings -> the jobs table row shape with the source's
    literal defaults (remote 0, no salary numbers, score 85, empty tags,
    version 1, platform ``career_page``), ``job_type`` NULL -> full-time
    (empty string kept), company and url filled when NULL or empty: the
    company with the crawl's ``company_name`` (a column; without one it stays
    blank). The id is ``short-hash(batch url)-position-epoch``: the career
    page whose batch the posting came in and its place there (by default each
    page is a batch of its own). ``job_hash`` is of url‖title‖company."""
    ok = parsed.filter(F.col("parse_strategy").isin("jsonld", "heuristics"))
    src_url = S.fill_blank(F.lit(None).cast("string"), F.col(page_url))
    ts = S.clock(crawled_at) if crawled_at is not None else F.lit(None).cast("timestamp_ntz")
    # posted/updated times: RFC 3339 text when the row has it, else the crawl time
    posted = S.parse_rfc3339(F.col("date_posted") if "date_posted" in parsed.columns
                             else F.lit(None).cast("string"), ts)
    place = F.col(batch_pos) if batch_pos else F.lit(0)
    company = S.fill_blank("company", company_name if company_name is not None else F.lit(""))
    return ok.select(
        S.batch_row_id(F.col(batch_url or page_url), place, F.lit(epoch)).alias("id"),
        S.job_hash(src_url, F.col("title"), company).alias("job_hash"),
        F.coalesce("title", F.lit("")).alias("title"),
        company.alias("company"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("location", F.lit("")).alias("location"),
        F.lit(0).alias("remote"),
        F.lit(None).cast("int").alias("salary_min"), F.lit(None).cast("int").alias("salary_max"),
        F.lit(None).cast("string").alias("currency"),
        F.coalesce(F.col("job_type"), F.lit(rules.DEFAULT_JOB_TYPE)).alias("job_type"),
        F.lit(None).cast("string").alias("experience_level"),
        F.lit(rules.DEFAULT_REAL_SCORE).alias("real_score"),
        src_url.alias("source_url"),
        F.lit(rules.DEFAULT_PLATFORM).alias("source_platform"),
        F.array().cast("array<string>").alias("tags"),
        posted.alias("posted_at"), posted.alias("updated_at"), ts.alias("crawled_at"),
        F.lit(rules.DEFAULT_VERSION).cast("long").alias("version"),
    )
