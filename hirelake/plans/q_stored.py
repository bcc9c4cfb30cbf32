"""Queries: state after each event, assignment, stored tables, cascades,
sources that fail, top facets, user extractors and SQL row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import scalars as S
from hirelake.operators import discovery as X
from hirelake.operators import extractors as E
from hirelake.operators import health as H
from hirelake.operators import search as R
from hirelake.operators import stored as K
from hirelake.operators import upsert as U
from hirelake.plans.q_dedupe import _HEALTH_SQL, _health
from hirelake.plans.q_discovery import org_to_company
from hirelake.plans.q_documents import jsonld_pages
from hirelake.plans.registry import query
from hirelake.plans.q_search import FACETS
from hirelake.session import scratch_path
from hirelake.sources import tables as T
from hirelake.sources import web as W
from hirelake.sources.tables import POSTINGS_SQL, QUEUE_SQL, with_sql

# ---------------------------------------------------------------- health after each event, assignment


@query("health_timeline", ids=("E7",), sql="""
WITH ev AS (SELECT event_id, ts, user_id, event_type = 'purchase' AS s, event_type = 'error' AS f
            FROM events WHERE event_type IN ('purchase', 'error')),
r AS (SELECT *, count(*) FILTER (WHERE s) OVER w AS ns, count(*) FILTER (WHERE f) OVER w AS nf FROM ev
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, nf - coalesce(max(CASE WHEN s THEN nf END) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS fail_count FROM r)
SELECT event_id, ts, user_id, CAST(ns AS BIGINT) AS success_count, CAST(fail_count AS BIGINT) AS fail_count,
       fail_count < 3 AS is_healthy FROM l""")
def health_timeline(spark, sf):
    e = T.read_table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    out = H.health_timeline(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "error")
    return out.drop("event_type")


@query("proxy_assign", ids=("E8", "B28"), sql=with_sql(_HEALTH_SQL, QUEUE_SQL) + """
, placed AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS size FROM pool),
usable AS (SELECT user_id, row_number() OVER (ORDER BY (place - 1 + size) % size) - 1 AS turn, count(*) OVER () AS n
           FROM placed WHERE is_healthy OR fail_count < 3),
req AS (SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) - 1 AS no FROM queue WHERE status = 'pending')
SELECT r.id, r.created_at, u.user_id AS proxy FROM req r LEFT JOIN usable u ON r.no % u.n = u.turn""")
def proxy_assign(spark, sf):
    """Pending queue rows as requests, the keys of the health state as pool."""
    requests = T.crawl_queue(spark, sf).filter("status = 'pending'").select("id", "created_at")
    pool = _health(spark, sf).select("user_id", "is_healthy", "fail_count")
    return H.assign(requests, pool, [F.col("created_at"), F.col("id")], [F.col("user_id")], "user_id", "proxy")


# ---------------------------------------------------------------- stored tables


@query("upsert_stored", ids=("A9", "K3", "A12"), sql="""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts,
       arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY user_id""")
def upsert_stored(spark, sf):
    """The events come in three batches, by kind; every batch rewrites only
    the buckets of its users, the last one twice under one epoch."""
    e = T.read_table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    path = scratch_path(spark, "upserted")
    keys, order = ["user_id"], ["ts", "event_id"]
    parts = [e.filter(F.col("event_type").isin("view", "signup")), e.filter("event_type = 'error'"),
             e.filter(~F.col("event_type").isin("view", "signup", "error"))]
    for epoch, part in enumerate([*parts, parts[-1]]):
        K.upsert(part, path, min(epoch, 2), keys, order, buckets=16)
    K.vacuum(spark, path)
    return K.read_upserted(spark, path, e.schema)


@query("append_batches", ids=("A3", "A4", "A6"), sql="""
SELECT strftime(o_orderdate, '%Y%m') AS ym, o_orderstatus AS batch, count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS last_key
FROM orders GROUP BY 1, 2""")
def append_batches(spark, sf):
    """Orders stored by month, a batch for each status; each batch is sent twice."""
    o = T.read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    o = o.withColumn("ym", S.year_month("o_orderdate").cast("string"))
    path = scratch_path(spark, "appended")
    rows = o.drop("o_orderstatus")
    for status in [r[0] for r in o.select("o_orderstatus").distinct().collect()] * 2:  # three states by the data model
        K.append_once(o.filter(F.col("o_orderstatus") == status).drop("o_orderstatus"), path, status, ("ym",))
    return K.read_appended(spark, path, rows.schema).groupBy("ym", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))


# ---------------------------------------------------------------- cascades


@query("cascade_all", ids=("C5",), sql="""
WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0),
u AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM c)),
q AS (SELECT event_id AS id FROM events WHERE event_id IN (SELECT id FROM u)),
r AS (SELECT page_id AS id FROM pages WHERE page_id IN (SELECT id FROM q))
SELECT 'company' AS kind, CAST(id AS BIGINT) AS key, 0 AS level FROM c UNION ALL SELECT 'url', id, 1 FROM u
UNION ALL SELECT 'queue', id, 2 FROM q UNION ALL SELECT 'result', id, 3 FROM r""")
def cascade_all(spark, sf):
    """Companies in debt go, and with them their URLs, those URLs' queue rows
    and what was fetched for them."""
    def edges(df, kind, key, parent_kind, parent):
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"),
                         F.lit(parent_kind).alias("parent_kind"), F.col(parent).cast("long").alias("parent_key"))

    e = edges(T.read_table(spark, sf, "orders"), "url", "o_orderkey", "company", "o_custkey").unionByName(
        edges(T.crawl_queue(spark, sf), "queue", "id", "url", "url_id")).unionByName(
        edges(T.read_table(spark, sf, "pages"), "result", "page_id", "queue", "page_id"))
    gone = T.read_table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.lit("company").alias("kind"), F.col("c_custkey").cast("long").alias("key"))
    return U.cascade_all(e, gone)


# ---------------------------------------------------------------- sources that fail

SOURCES = ["github", "google_dork", "manual", "crunchbase"]


def _sources(spark, sf):
    """Two sources that answer, one whose feed is not there (fails when it is
    planned) and one with a broken row (fails when it runs)."""
    def broken():
        rows = W.page_hosts(spark, sf).select(F.col("domain").alias("name"), "domain")
        return rows.withColumn("name", F.when(F.length("domain") > 0, F.raise_error(F.lit("broken row"))).otherwise(F.col("name")))

    return {
        "github": lambda: org_to_company(spark, sf).select("name", "domain"),
        "google_dork": lambda: spark.read.parquet(f"{sf}/dork_feed.parquet").select("name", "domain"),
        "manual": lambda: W.page_hosts(spark, sf).select("domain").distinct().select(F.col("domain").alias("name"), "domain"),
        "crunchbase": broken,
    }


_FOUND_SQL = """, found AS (
SELECT 'github' AS source, CASE WHEN c_acctbal < 500 THEN lower(replace(c_name, '#', '-')) ELSE c_name END AS name,
       concat(lower(replace(c_name, '#', '-')), '.example.com') AS domain FROM customer
UNION ALL SELECT 'manual', domain, domain FROM (SELECT DISTINCT domain FROM ph))
"""


@query("discover_partial", ids=("G1", "L3"), sql=with_sql(W.PAGE_HOSTS_SQL) + _FOUND_SQL + "SELECT source, name, domain FROM found")
def discover_partial(spark, sf):
    rows, _ = X.dispatch_written(_sources(spark, sf), SOURCES, scratch_path(spark, "sources"))
    return rows.select("source", "name", "domain")


@query("discover_status", ids=("G1", "L3"), sql=with_sql(W.PAGE_HOSTS_SQL) + _FOUND_SQL + """
SELECT s.source, CASE WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status, coalesce(n, 0) AS rows, n IS NULL AS has_error
FROM (SELECT unnest(['github', 'google_dork', 'manual', 'crunchbase']) AS source) s
LEFT JOIN (SELECT source, count(*) AS n FROM found GROUP BY source) f ON s.source = f.source""")
def discover_status(spark, sf):
    _, statuses = X.dispatch_written(_sources(spark, sf), SOURCES, scratch_path(spark, "sources"))
    return statuses.select("source", "status", "rows", F.col("error").isNotNull().alias("has_error"))


# ---------------------------------------------------------------- top facets

TOP_FACETS = ["title", *FACETS]


@query("facets_top", ids=("D6", "J5"), sql=with_sql(POSTINGS_SQL) + ", v AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value FROM jobs WHERE {f} IS NOT NULL" for f in TOP_FACETS[:-1]) + """
UNION ALL SELECT 'tags', unnest([lower(company), lower(location)]) FROM jobs),
c AS (SELECT facet, value, count(*) AS n FROM v GROUP BY ALL)
SELECT facet, CAST(rank AS INTEGER) AS rank, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM c) WHERE rank <= 10""")
def facets_top(spark, sf):
    """Ten values of each facet; of the titles thousands tie, so they are
    counted in full."""
    return R.facets_top(T.postings(spark, sf), TOP_FACETS, 10)


# ---------------------------------------------------------------- extractors and row generators

_HOST = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"


@query("extract", ids=("L2", "I1"), sql=f"""
WITH a AS (SELECT page_id, url, html, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages),
h AS (SELECT *, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading,
             list_filter(hrefs, lambda x: x LIKE '%://%' AND regexp_extract(x, {_HOST}, 1) <> regexp_extract(url, {_HOST}, 1)) AS outer_links
      FROM a)
SELECT page_id, url, trim(heading) AS heading, CAST(len(hrefs) AS INTEGER) AS n, CAST(len(hrefs) - len(outer_links) AS INTEGER) AS inside,
       contains(html, '<article>') AS whole FROM h""")
def extract(spark, sf):
    """Two extractors that come with the package and one registered here, in one pass."""
    if "article_only" not in E.registered():
        E.extractor("article_only", "string")(_article_only)
    rows = E.extract(T.spread(T.read_table(spark, sf, "pages")), ["heading", "links", "article_only"])
    return rows.select("page_id", "url", "heading", "links.n", "links.inside", F.col("article_only_error").isNull().alias("whole"))


def _article_only(url, html):
    begin = html.index("<article>")  # a page without one is an error of this extractor
    return html[begin:]


_A_PAT = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


@query("sql_anchors", ids=("L4", "I1", "H4"), sql=f"""
SELECT page_id, pos, href, concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), href) AS abs_url, title AS text
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{_A_PAT}', 1)) AS href,
             unnest(regexp_extract_all(html, '{_A_PAT}', 2)) AS title,
             generate_subscripts(regexp_extract_all(html, '{_A_PAT}', 1), 1) - 1 AS pos FROM pages)""")
def sql_anchors(spark, sf):
    E.register_generators(spark)
    return spark.sql("SELECT p.page_id, CAST(a.pos AS BIGINT) AS pos, a.href, a.abs_url, a.text "
                     "FROM {pages} p, LATERAL page_anchors(p.url, p.html) a",
                     pages=T.spread(T.read_table(spark, sf, "pages")))


@query("sql_jsonld", ids=("L4", "I3"), sql="""
WITH j AS (SELECT doc_id AS page_id, lang, CASE WHEN p_size > 3 THEN 'JobPosting' END AS item_type,
                  CASE WHEN p_size NOT IN (4, 5) THEN p_name END AS title FROM documents JOIN part ON doc_id = p_partkey)
SELECT page_id, CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS pos, item_type, title FROM j
UNION ALL SELECT page_id, 0, 'Organization', NULL FROM j WHERE lang = 'de'""")
def sql_jsonld(spark, sf):
    E.register_generators(spark)
    return spark.sql("SELECT p.page_id, a.pos, a.item_type, a.title FROM {pages} p, LATERAL page_jsonld(p.html) a",
                     pages=jsonld_pages(spark, sf))
