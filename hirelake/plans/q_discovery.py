"""Queries of the discovery side: URL/company tables, targets, upserts,
hosts, career-page scoring, ATS tagging, emails, search-result records."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import rules
from hirelake.functions import scalars as S
from hirelake.operators import aggregates as A
from hirelake.operators import dedupe as D
from hirelake.operators import discovery as X
from hirelake.operators import joins as J
from hirelake.operators import listing as L
from hirelake.operators import upsert as U
from hirelake.plans import sqlgen as G
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources import web as W
from hirelake.sources.tables import (
    AS_OF_ORDERS, COMPANIES_SQL, COMPANY_CRAWL_SQL, QUEUE_SQL, URLS_DOMAIN_SQL, URLS_SQL, with_sql,
)

# ---------------------------------------------------------------- URL table aggregates


@query("ats_distribution", ids=("D2", "B6", "F4", "T6"), sql=with_sql(URLS_SQL) + """
SELECT ats_platform, count(*) AS total_urls,
       count(CASE WHEN crawl_status = 'completed' THEN 1 END) AS crawled_urls,
       count(CASE WHEN is_active THEN 1 END) AS active_urls,
       round(avg(confidence), 6) AS avg_confidence
FROM urls WHERE ats_platform IS NOT NULL GROUP BY ats_platform ORDER BY total_urls DESC""")
def ats_distribution(spark, sf):
    return A.url_distribution(T.discovered_urls(spark, sf)).withColumn(
        "avg_confidence", F.round("avg_confidence", 6))


@query("ats_statistics", ids=("D13",), sql=with_sql(URLS_SQL) + """
SELECT ats_platform AS platform, CAST(count(*) AS INTEGER) AS total_urls,
       CAST(count(*) FILTER (WHERE is_active) AS INTEGER) AS active_urls
FROM urls WHERE ats_platform IS NOT NULL GROUP BY ats_platform""")
def ats_statistics(spark, sf):
    return A.platform_statistics(T.discovered_urls(spark, sf))


@query("ats_histogram", ids=("D3",), sql=with_sql(URLS_SQL) + """
SELECT string_agg(k || '=' || CAST(v AS VARCHAR), ',' ORDER BY k) AS histogram_text, count(*) AS n_platforms
FROM (SELECT ats_platform AS k, count(*) AS v FROM urls
      WHERE ats_platform IS NOT NULL AND ats_platform <> '' GROUP BY 1)""")
def ats_histogram(spark, sf):
    h = A.platform_histogram(T.discovered_urls(spark, sf))
    entries = F.map_entries("histogram")
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return h.select(text.alias("histogram_text"), F.size(entries).cast("long").alias("n_platforms"))


# ---------------------------------------------------------------- companies: stale, touch


@query("stalest", ids=("B4", "F2", "T15"), sql=with_sql(COMPANIES_SQL, COMPANY_CRAWL_SQL) + f"""
SELECT id, name, domain, last_crawled_at FROM companies_c
WHERE is_active AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 7 DAY)
ORDER BY last_crawled_at ASC NULLS FIRST, id LIMIT 50""")
def stalest(spark, sf):
    return L.stalest(T.company_last_crawl(spark, sf), AS_OF_ORDERS, days=7, n=50).select(
        "id", "name", "domain", "last_crawled_at")


@query("touch_crawled", ids=("A15", "K6"), sql=with_sql(COMPANIES_SQL, COMPANY_CRAWL_SQL) + f"""
, due AS (
  SELECT id FROM companies_c
  WHERE is_active AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 7 DAY))
SELECT c.id, CASE WHEN d.id IS NOT NULL THEN TIMESTAMP '{AS_OF_ORDERS}' ELSE c.last_crawled_at END AS last_crawled_at
FROM companies_c c LEFT JOIN due d ON c.id = d.id""")
def touch_crawled(spark, sf):
    comp = T.company_last_crawl(spark, sf)
    due = L.stale_filter(comp, AS_OF_ORDERS, 7)
    return L.touch_crawled(comp, due, AS_OF_ORDERS).select("id", "last_crawled_at")


# ---------------------------------------------------------------- joins


@query("targets_view", ids=("C1", "B5", "F3"), sql=with_sql(URLS_SQL, COMPANIES_SQL, QUEUE_SQL) + """
SELECT u.id, u.url, u.ats_platform, u.page_type, round(u.confidence, 6) AS confidence, u.priority,
       c.name AS company_name, c.domain AS company_domain, q.status AS crawl_status, q.retry_count,
       u.discovered_at
FROM urls u LEFT JOIN companies c ON u.company_id = c.id LEFT JOIN queue q ON q.url_id = u.id
WHERE u.is_active AND u.crawl_status = 'pending' AND (q.status IS NULL OR q.status = 'pending')
""")
def targets_view(spark, sf):
    t = J.targets(T.discovered_urls(spark, sf), T.companies(spark, sf), T.crawl_queue(spark, sf))
    return t.withColumn("confidence", F.round("confidence", 6))


@query("attach_company", ids=("C2",), sql=with_sql(URLS_DOMAIN_SQL, COMPANIES_SQL) + """
, firsts AS (SELECT domain, min(id) AS company_id FROM companies GROUP BY domain)
SELECT u.id, u.domain, f.company_id FROM urls_d u LEFT JOIN firsts f ON u.domain = f.domain""")
def attach_company(spark, sf):
    urls = T.discovered_urls(spark, sf, with_domain=True).select("id", "domain")
    return J.attach_company(urls, T.companies(spark, sf)).select("id", "domain", "company_id")


@query("name_of", ids=("C3", "T18"), sql=with_sql(URLS_DOMAIN_SQL, COMPANIES_SQL) + """
, firsts AS (SELECT domain, arg_min(name, id) AS company_name FROM companies GROUP BY domain)
SELECT d.domain, coalesce(f.company_name, d.domain) AS company_name
FROM (SELECT DISTINCT domain FROM urls_d) d LEFT JOIN firsts f ON d.domain = f.domain""")
def name_of(spark, sf):
    urls = T.discovered_urls(spark, sf, with_domain=True).select("domain")
    return J.name_of(urls, T.companies(spark, sf))


@query("seed_absent", ids=("A13", "C4"), sql="""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def seed_absent(spark, sf):
    """Customers as seeds, those with an order in progress being there already."""
    added, _ = U.seed(*_seed_tables(spark, sf), "c_custkey", "o_custkey")
    return added


def _seed_tables(spark, sf):
    seeds = T.read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return T.read_table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select("o_custkey"), seeds


@query("seed_counts", ids=("A13",), sql="""
SELECT count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS added,
       count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS skipped
FROM customer""")
def seed_counts(spark, sf):
    _, counts = U.seed(*_seed_tables(spark, sf), "c_custkey", "o_custkey")
    return counts


_DOC_HASH_SQL = """
docs AS (SELECT doc_id, sha256(text) AS text_hash, lang, source, n_chars FROM documents)"""


def _docs(spark, sf):
    d = T.read_table(spark, sf, "documents")
    return d.select("doc_id", S.url_hash("text").alias("text_hash"), "lang", "source", "n_chars")


@query("seen_hash", ids=("C11", "H1"), sql=with_sql(_DOC_HASH_SQL) + """
SELECT n.doc_id, n.text_hash, o.text_hash IS NOT NULL AS seen
FROM (SELECT * FROM docs WHERE source <> 'src0') n
LEFT JOIN (SELECT DISTINCT text_hash FROM docs WHERE source = 'src0') o ON n.text_hash = o.text_hash""")
def seen_hash(spark, sf):
    d = _docs(spark, sf)
    new, old = d.filter(F.col("source") != "src0"), d.filter(F.col("source") == "src0")
    return U.mark_seen(new.select("doc_id", "text_hash"), old, "text_hash")


@query("new_only", ids=("C4", "C11"), sql=with_sql(_DOC_HASH_SQL) + """
SELECT doc_id, text_hash FROM docs n WHERE source <> 'src0'
AND NOT EXISTS (SELECT 1 FROM docs o WHERE o.source = 'src0' AND o.text_hash = n.text_hash)""")
def new_only(spark, sf):
    d = _docs(spark, sf)
    return U.new_only(d.filter(F.col("source") != "src0").select("doc_id", "text_hash"),
                      d.filter(F.col("source") == "src0"), "text_hash")


@query("cascade_delete", ids=("C5",), sql="""
SELECT l_returnflag, count(*) AS n_lines FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')
GROUP BY l_returnflag""")
def cascade_delete(spark, sf):
    li = T.read_table(spark, sf, "lineitem")
    surviving = T.read_table(spark, sf, "orders").filter(F.col("o_orderstatus") != "F")
    kept = U.cascade(li, surviving, "l_orderkey", "o_orderkey")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_lines"))


# ---------------------------------------------------------------- upserts


_URL_UPSERT_SQL = """
u AS (SELECT sha256(text) AS url_hash, doc_id AS id, lang AS page_type, n_chars / 40000.0 AS confidence,
             CAST(substr(source, 4) AS INTEGER) AS priority,
             CAST(lang <> 'en' AS BIGINT) * 10000000000 + doc_id AS ord FROM documents)"""


def _url_rows(spark, sf):
    d = T.read_table(spark, sf, "documents")
    return d.select(S.url_hash("text").alias("url_hash"), F.col("doc_id").alias("id"),
                    F.col("lang").alias("page_type"), (F.col("n_chars") / 40000.0).alias("confidence"),
                    F.substr("source", F.lit(4)).cast("int").alias("priority"),
                    F.col("doc_id").alias("seq"), "lang")


@query("url_upsert", ids=("A12", "T7", "H24", "L1"), sql=with_sql(_URL_UPSERT_SQL) + """
SELECT url_hash, arg_min(id, ord) AS id, arg_min(page_type, ord) AS page_type,
       round(max(confidence), 6) AS confidence, max(priority) AS priority
FROM u GROUP BY url_hash""")
def url_upsert(spark, sf):
    rows = _url_rows(spark, sf)
    cols = ["url_hash", "id", "page_type", "confidence", "priority", "seq"]
    existing = rows.filter(F.col("lang") == "en").select(*cols)
    incoming = rows.filter(F.col("lang") != "en").select(*cols)
    out = U.upsert_urls(existing, incoming, key="url_hash", seq="seq")
    return out.select("url_hash", "id", "page_type", F.round("confidence", 6).alias("confidence"), "priority")


_COMPANY_UPSERT_SQL = """
c AS (SELECT concat(source, '.example.org') AS domain, doc_id AS id,
             concat('Org ', CAST(doc_id AS VARCHAR)) AS name,
             CASE lang WHEN 'fr' THEN '' WHEN 'de' THEN NULL ELSE text END AS description,
             lang AS source, CAST(lang <> 'en' AS BIGINT) * 10000000000 + doc_id AS ord FROM documents)"""


@query("company_upsert", ids=("A11", "T6", "T7"), sql=with_sql(_COMPANY_UPSERT_SQL) + """
SELECT domain, arg_min(id, ord) AS id, arg_max(name, ord) AS name,
       arg_max(description, ord) FILTER (WHERE description IS NOT NULL) AS description,
       arg_min(source, ord) AS source
FROM c GROUP BY domain""")
def company_upsert(spark, sf):
    d = T.read_table(spark, sf, "documents")
    rows = d.select(F.concat(F.col("source"), F.lit(".example.org")).alias("domain"), F.col("doc_id").alias("id"),
                    F.concat(F.lit("Org "), F.col("doc_id").cast("string")).alias("name"),
                    F.when(F.col("lang") == "fr", F.lit("")).when(F.col("lang") == "de", F.lit(None).cast("string"))
                    .otherwise(F.col("text")).alias("description"),
                    F.col("lang").alias("source"), F.col("doc_id").alias("seq"), "lang")
    cols = ["domain", "id", "name", "description", "source", "seq"]
    existing = rows.filter(F.col("lang") == "en").select(*cols)
    incoming = rows.filter(F.col("lang") != "en").select(*cols)
    return U.upsert_companies(existing, incoming).select("domain", "id", "name", "description", "source")


# ---------------------------------------------------------------- candidates / templates


@query("candidates", ids=("C6", "H7"), sql=with_sql(W.PAGE_HOSTS_SQL) + """
, d AS (SELECT DISTINCT domain FROM ph)
SELECT domain, 'subdomain' AS kind, kw AS keyword, concat('https://', kw, '.', domain) AS candidate
FROM d, (SELECT unnest([""" + ", ".join(G.lit(k) for k in rules.CAREER_KEYWORDS) + """]) AS kw)
UNION ALL
SELECT domain, 'path', kw, concat('https://', domain, '/', kw)
FROM d, (SELECT unnest([""" + ", ".join(G.lit(k) for k in rules.CAREER_KEYWORDS) + """]) AS kw)
UNION ALL
SELECT domain, 'dns', kw, concat(kw, '.', domain)
FROM d, (SELECT unnest([""" + ", ".join(G.lit(k) for k in rules.JOB_HOST_KEYWORDS) + """]) AS kw)""")
def candidates(spark, sf):
    doms = W.page_hosts(spark, sf).select("domain").distinct()
    return J.candidates(doms)


@query("templates", ids=("C7",), sql="""
SELECT keyword, template_id, query FROM (SELECT DISTINCT p_name AS keyword FROM part),
(SELECT unnest(range(""" + str(len(rules.KEYWORD_QUERY_TEMPLATES)) + """)) AS template_id,
        unnest([""" + ", ".join(G.lit(t) for t in rules.KEYWORD_QUERY_TEMPLATES) + """]) AS tpl)
CROSS JOIN LATERAL (SELECT replace(tpl, '{kw}', keyword) AS query)""")
def templates(spark, sf):
    kws = T.read_table(spark, sf, "part").select(F.col("p_name").alias("keyword")).distinct()
    return J.query_templates(kws).select("keyword", F.col("template_id").cast("bigint").alias("template_id"), "query")


# ---------------------------------------------------------------- hosts


_CT_HOSTS_SQL = """
cth AS (
  SELECT page_id, domain, pos - 1 AS line_pos, replace(trim(raw), '*.', '') AS subdomain
  FROM (SELECT page_id, domain, unnest(string_split(name_value, chr(10))) AS raw,
               generate_subscripts(string_split(name_value, chr(10)), 1) AS pos FROM ct)
  WHERE replace(trim(raw), '*.', '') <> '' AND ends_with(replace(trim(raw), '*.', ''), domain)
),
hv AS (
  SELECT page_id, domain, subdomain FROM hraw WHERE contains(subdomain, domain)
),
allh AS (
  SELECT page_id, domain, line_pos, subdomain, 'crt' AS method, 1 AS mrank FROM cth
  UNION ALL
  SELECT page_id, domain, 0, subdomain, 'theharvester', 3 FROM hv
)"""


def _all_hosts(spark, sf):
    ct = X.ct_hosts(W.ct_entries(spark, sf))
    hv = X.harvest_hosts(W.harvested(spark, sf)).withColumn("line_pos", F.lit(0))
    cols = ["page_id", "domain", "line_pos", "subdomain", "method", "is_job_related"]
    return ct.select(*cols).unionByName(hv.select(*cols))


@query("ct_hosts", ids=("I9", "H8", "B18", "B19", "L4"),
       sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL) + """
SELECT page_id, domain, line_pos, subdomain, 'crt' AS method,
       """ + G.contains_any("lower(subdomain)", rules.JOB_HOST_KEYWORDS) + """ AS is_job_related
FROM cth""")
def ct_hosts(spark, sf):
    return X.ct_hosts(W.ct_entries(spark, sf)).select(
        "page_id", "domain", F.col("line_pos").cast("bigint").alias("line_pos"), "subdomain", "method",
        "is_job_related")


@query("harvest_hosts", ids=("I10", "H9", "B18"), sql=with_sql(W.PAGE_HOSTS_SQL, W.HARVESTED_SQL) + """
SELECT page_id, domain, subdomain, 'theharvester' AS method,
       """ + G.contains_any("subdomain", rules.JOB_HOST_KEYWORDS) + """ AS is_job_related
FROM hraw WHERE contains(subdomain, domain)""")
def harvest_hosts(spark, sf):
    return X.harvest_hosts(W.harvested(spark, sf)).select("page_id", "domain", "subdomain", "method",
                                                         "is_job_related")


@query("host_summary", ids=("D19",), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL) + """
SELECT domain, count(DISTINCT subdomain) AS total_found,
       count(DISTINCT CASE WHEN """ + G.contains_any("lower(subdomain)", rules.JOB_HOST_KEYWORDS) + """ THEN subdomain END) AS job_related
FROM allh GROUP BY domain""")
def host_summary(spark, sf):
    return X.host_summary(_all_hosts(spark, sf))


_PAGES_SQL = """
cp AS (SELECT DISTINCT domain, url, 'careers' AS page_type, CAST(0.9 AS DOUBLE) AS confidence, 1 AS priority FROM ph),
hp AS (SELECT DISTINCT domain, concat('https://', subdomain) AS url, 'subdomain' AS page_type,
              CASE WHEN j THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence, CASE WHEN j THEN 1 ELSE 2 END AS priority
       FROM (SELECT domain, subdomain, """ + G.contains_any("lower(subdomain)", rules.JOB_HOST_KEYWORDS) + """ AS j FROM allh)),
both_ AS (SELECT * FROM cp UNION ALL SELECT * FROM hp)"""


def _company_pages(spark, sf):
    pages = W.page_hosts(spark, sf).select(
        "domain", "url", F.lit("careers").alias("page_type"), F.lit(0.9).alias("confidence"), F.lit(1).alias("priority")).distinct()
    hosts = X.host_pages(_all_hosts(spark, sf).select("domain", "subdomain", "is_job_related").distinct())
    return X.career_pages(pages, hosts)


@query("career_pages", ids=("G2",), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL, _PAGES_SQL) + """
SELECT * FROM both_""")
def career_pages(spark, sf):
    return _company_pages(spark, sf)


@query("discovery_totals", ids=("D10",), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL, _PAGES_SQL) + """
SELECT (SELECT count(DISTINCT domain) FROM ph) AS companies_found, (SELECT count(*) FROM both_) AS career_pages_found,
       (SELECT count(DISTINCT url) FROM both_ WHERE priority = 1) AS urls_queued""")
def discovery_totals(spark, sf):
    pages = _company_pages(spark, sf)
    companies = W.page_hosts(spark, sf).select("domain").distinct()
    return X.discovery_totals(companies, pages, pages.filter("priority = 1").select("url").distinct())


@query("union_sources", ids=("G1",), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL) + """
SELECT method, count(*) AS n_rows, count(DISTINCT subdomain) AS n_hosts FROM allh GROUP BY method""")
def union_sources(spark, sf):
    return _all_hosts(spark, sf).groupBy("method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("subdomain").alias("n_hosts"))


@query("dedup_hosts", ids=("E2", "G3", "B22"), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL) + """
SELECT subdomain, method, domain, page_id FROM (
  SELECT *, row_number() OVER (PARTITION BY subdomain ORDER BY mrank, page_id, line_pos) AS rn FROM allh)
WHERE rn = 1""")
def dedup_hosts(spark, sf):
    hosts = _all_hosts(spark, sf).withColumn("seq", F.struct("page_id", "line_pos"))
    out = D.dedup_hosts(X.by_method(hosts, ["crt", "dns", "theharvester"]))
    return out.select("subdomain", "method", "domain", "page_id")


@query("host_pages", ids=("H15", "T5"), sql=with_sql(W.PAGE_HOSTS_SQL, W.CT_ENTRIES_SQL, W.HARVESTED_SQL, _CT_HOSTS_SQL) + """
SELECT subdomain, concat('https://', subdomain) AS url, 'subdomain' AS page_type,
       CASE WHEN j THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence,
       CASE WHEN j THEN 1 ELSE 2 END AS priority
FROM (SELECT DISTINCT subdomain, """ + G.contains_any("lower(subdomain)", rules.JOB_HOST_KEYWORDS) + """ AS j FROM allh)""")
def host_pages(spark, sf):
    hosts = _all_hosts(spark, sf).select("subdomain", "is_job_related").distinct()
    return X.host_pages(hosts).select("subdomain", "url", "page_type", "confidence", "priority")


# ---------------------------------------------------------------- career pages, fetch log


@query("career_score", ids=("I8", "C8", "B20", "B21", "H11", "H12"), sql=with_sql(W.CAREER_FETCH_SQL) + """
SELECT url,
       CASE WHEN kind = 'subdomain' THEN split_part(""" + W.HOST_SQL.format(u="url") + """, '.', 1)
            ELSE regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/([^/]*)', 1) END AS page_type,
       round(least(CAST(1.0 AS DOUBLE), CASE WHEN kind = 'subdomain' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END
                   + CAST(0.1 AS DOUBLE) * n), 10) AS confidence,
       kind AS discovered_via, n AS n_keywords
FROM (SELECT *, """ + G.count_present("lower(content)", rules.CAREER_KEYWORDS) + """ AS n FROM cfetch)
WHERE status = 200 AND n >= 2""")
def career_score(spark, sf):
    # both candidates of each document's site; the log knows one of them
    d = T.read_table(spark, sf, "documents").select("doc_id", "source")
    site, tail = F.concat("source", F.lit(".example.com/")), F.col("doc_id").cast("string")
    cands = d.select(F.inline(F.array(
        F.struct(F.lit("subdomain").alias("kind"), F.concat(F.lit("https://careers."), site, tail).alias("candidate")),
        F.struct(F.lit("path").alias("kind"), F.concat(F.lit("https://"), site, F.lit("careers/"), tail).alias("candidate")))))
    fetched = J.probe(cands, W.career_fetch_log(spark, sf).select("url", "content", "status"))
    return X.score_career_pages(fetched)


@query("fetch_classify", ids=("B17", "B21", "A2"), sql=with_sql(W.PAGE_FETCH_SQL) + """
SELECT page_id, url, status, status < 400 AS success,
       CAST(length(CASE WHEN status < 400 THEN html ELSE '' END) AS INTEGER) AS html_chars,
       CASE WHEN status < 400 THEN NULL ELSE concat('HTTP ', CAST(status AS VARCHAR)) END AS error,
       status < 500 AS host_alive
FROM plog""")
def fetch_classify(spark, sf):
    c = X.classify_fetch(W.page_fetch_log(spark, sf))
    return c.select("page_id", "url", "status", "success", F.length("html").alias("html_chars"), "error",
                    "host_alive")


@query("batch_summary", ids=("D18", "D19"), sql=with_sql(W.PAGE_FETCH_SQL) + """
SELECT count(*) AS requested, count(*) FILTER (WHERE status < 400) AS ok,
       count(*) FILTER (WHERE status >= 400) AS failed FROM plog""")
def batch_summary(spark, sf):
    return X.batch_summary(X.classify_fetch(W.page_fetch_log(spark, sf)))


# ---------------------------------------------------------------- ATS tagging, titles, company names

_ATS_CASES_SQL = """
cases AS (
  SELECT p.page_id, CASE WHEN p.page_id % 24 = 11 THEN concat(p.html, '<!-- Powered by Greenhouse -->') ELSE p.html END AS html,
         CAST(p.page_id % 12 AS INTEGER) AS c,
         CASE CAST(p.page_id % 12 AS INTEGER)
           WHEN 0 THEN concat('https://boards.greenhouse.io/', h.host, '/jobs/', CAST(p.page_id AS VARCHAR))
           WHEN 1 THEN concat('https://jobs.lever.co/', h.host, '/jobs/', CAST(p.page_id AS VARCHAR))
           WHEN 2 THEN concat('https://jobs.lever.co/', h.host)
           WHEN 3 THEN concat('https://jobs.ashbyhq.com/', h.host)
           WHEN 4 THEN concat('https://', h.host, '/jobs')
           WHEN 5 THEN concat('https://www.linkedin.com/jobs/view/', CAST(p.page_id AS VARCHAR))
           WHEN 6 THEN concat('https://', h.host, '.myworkdayjobs.com/en')
           WHEN 7 THEN concat('https://', h.host, '/viewjob?jk=', CAST(p.page_id AS VARCHAR))
           WHEN 8 THEN concat('https://', h.host, '/cmp/acme')
           WHEN 9 THEN concat('https://acme.bamboohr.com/careers/', CAST(p.page_id AS VARCHAR))
           WHEN 10 THEN concat('https://careers-', h.host, '.icims.com/x')
           ELSE p.url END AS url
  FROM pages p JOIN ph h ON p.page_id = h.page_id
)"""


def _ats_cases(spark, sf):
    p = T.read_table(spark, sf, "pages")
    h = S.url_host("url")
    pid = F.col("page_id").cast("string")
    c = (F.col("page_id") % 12).cast("int")
    url = (F.when(c == 0, F.concat(F.lit("https://boards.greenhouse.io/"), h, F.lit("/jobs/"), pid))
           .when(c == 1, F.concat(F.lit("https://jobs.lever.co/"), h, F.lit("/jobs/"), pid))
           .when(c == 2, F.concat(F.lit("https://jobs.lever.co/"), h))
           .when(c == 3, F.concat(F.lit("https://jobs.ashbyhq.com/"), h))
           .when(c == 4, F.concat(F.lit("https://"), h, F.lit("/jobs")))
           .when(c == 5, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), pid))
           .when(c == 6, F.concat(F.lit("https://"), h, F.lit(".myworkdayjobs.com/en")))
           .when(c == 7, F.concat(F.lit("https://"), h, F.lit("/viewjob?jk="), pid))
           .when(c == 8, F.concat(F.lit("https://"), h, F.lit("/cmp/acme")))
           .when(c == 9, F.concat(F.lit("https://acme.bamboohr.com/careers/"), pid))
           .when(c == 10, F.concat(F.lit("https://careers-"), h, F.lit(".icims.com/x")))
           .otherwise(F.col("url")))
    html = F.when(F.col("page_id") % 24 == 11, F.concat("html", F.lit("<!-- Powered by Greenhouse -->"))).otherwise(F.col("html"))
    return p.select("page_id", html.alias("html"), c.alias("c"), url.alias("url"))


def _ats_sql(domain_first: bool) -> str:
    is_ats, plat, conf = G.ats_case("url", "CASE WHEN c = 11 THEN html END", domain_first)
    return (with_sql(W.PAGE_HOSTS_SQL, _ATS_CASES_SQL)
            + f"SELECT page_id, url, {is_ats} AS is_ats, {plat} AS platform, {conf} AS confidence FROM cases")


def _ats_query(spark, sf, domain_first: bool):
    df = _ats_cases(spark, sf)
    a = P.ats_classify("url", F.when(F.col("c") == 11, F.col("html")), domain_first)
    return df.select("page_id", "url", a["is_ats"].alias("is_ats"), a["platform"].alias("platform"),
                     a["confidence"].alias("confidence"))


@query("ats_url", ids=("H13", "H14", "T4", "I14"), sql=_ats_sql(False))
def ats_url(spark, sf):
    return _ats_query(spark, sf, False)


@query("ats_url_domain_first", ids=("H13",), sql=_ats_sql(True))
def ats_url_domain_first(spark, sf):
    return _ats_query(spark, sf, True)


_H1_SQL = G.unescape("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")


@query("title_valid", ids=("B8", "H10"), sql=f"""
SELECT page_id, title, {G.valid_title('title')} AS valid
FROM (SELECT page_id, {_H1_SQL} AS title FROM pages)""")
def title_valid(spark, sf):
    p = T.read_table(spark, sf, "pages")
    t = S.html_unescape_basic(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1))
    return p.select("page_id", t.alias("title")).withColumn("valid", P.valid_title("title"))


@query("company_from_url", ids=("H6", "I7", "H21"), sql="""
SELECT page_id, """ + G.capitalize("CASE WHEN len(string_split(dom, '.')) >= 2 THEN split_part(dom, '.', 1) ELSE dom END") + """ AS company
FROM (SELECT page_id, replace(replace(replace(
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), 'careers.', ''), 'jobs.', '') AS dom
      FROM pages)""")
def company_from_url(spark, sf):
    p = T.read_table(spark, sf, "pages")
    return p.select("page_id", S.company_from_url("url").alias("company"))


# ---------------------------------------------------------------- emails, org records, search results


@query("domain_emails", ids=("B23", "G6", "F11", "I11"), sql="""
SELECT DISTINCT domain, email FROM (
  SELECT CASE WHEN lang IN ('en', 'fr') THEN 'example.com' ELSE concat(lang, '.example.com') END AS domain,
         lower(trim(e)) AS email
  FROM (SELECT lang, unnest(regexp_extract_all(text, '""" + X.EMAIL_RE + """')) AS e FROM documents))
WHERE email <> '' AND contains(email, lower(domain))""")
def domain_emails(spark, sf):
    """Emails harvested per domain: addresses found in English/French documents
    count as harvested for ``example.com``, the others for ``<lang>.example.com``;
    only those containing their domain are kept."""
    d = T.read_table(spark, sf, "documents").select("lang", "text")
    dom = F.when(F.col("lang").isin("en", "fr"), F.lit("example.com")).otherwise(
        F.concat(F.col("lang"), F.lit(".example.com")))
    found = X.extract_emails(d).select(dom.alias("domain"), F.col("email").alias("raw_email"))
    return X.clean_harvested_emails(found)


@query("page_emails", ids=("I11",), sql=with_sql(W.PAGE_HOSTS_SQL) + """
, e AS (SELECT DISTINCT CASE WHEN lang IN ('en', 'fr') THEN 'example.com' ELSE concat(lang, '.example.com') END AS domain,
               lower(trim(e)) AS email
        FROM (SELECT lang, unnest(regexp_extract_all(text, '""" + X.EMAIL_RE + """')) AS e FROM documents)),
l AS (SELECT domain, list(email ORDER BY email) AS emails FROM e WHERE email <> '' AND contains(email, domain) GROUP BY domain),
p AS (SELECT page_id, CASE WHEN seg1 IN ('de', 'es') THEN concat(seg1, '.example.com')
                           ELSE regexp_extract(domain, '[^.]+[.][^.]+$') END AS domain FROM ph)
SELECT p.page_id, p.domain, CAST(coalesce(len(emails), 0) AS INTEGER) AS n_emails, emails[1] AS first_email,
       sha256(array_to_string(coalesce(emails, []), ',')) AS emails_sha256
FROM p LEFT JOIN l ON p.domain = l.domain""")
def page_emails(spark, sf):
    """Every page with the addresses harvested for its domain: that of its
    language's site for German and Spanish pages, else its registered one."""
    ph = W.page_hosts(spark, sf)
    dom = F.when(F.col("seg1").isin("de", "es"), F.concat("seg1", F.lit(".example.com"))).otherwise(
        F.regexp_extract("domain", r"[^.]+[.][^.]+$", 0))
    out = X.attach_emails(ph.select("page_id", dom.alias("domain")), domain_emails(spark, sf))
    return out.select("page_id", "domain", F.size("emails").alias("n_emails"), F.get("emails", 0).alias("first_email"),
                      F.sha2(F.array_join("emails", ","), 256).alias("emails_sha256"))


def _org_login(c):
    return F.lower(F.replace(c, F.lit("#"), F.lit("-")))


@query("org_to_company", ids=("I12", "H27", "H28", "G4"), sql="""
SELECT c_custkey,
       CASE WHEN c_acctbal < 500 THEN lower(replace(c_name, '#', '-')) ELSE c_name END AS name,
       concat(lower(replace(c_name, '#', '-')), '.example.com') AS domain,
       c_mktsegment AS description, 'github' AS source,
       json_object('github_url', concat('https://code.example.com/', lower(replace(c_name, '#', '-'))),
                   'repos', CAST(c_nationkey AS BIGINT), 'followers', CAST(floor(c_acctbal) AS BIGINT))::VARCHAR AS metadata
FROM customer""")
def org_to_company(spark, sf):
    c = T.read_table(spark, sf, "customer")
    login = _org_login(F.col("c_name"))
    name = (F.when(F.col("c_acctbal") < 0, F.lit("")).when(F.col("c_acctbal") < 500, F.lit(None).cast("string"))
            .otherwise(F.col("c_name")))
    body = F.to_json(F.struct(login.alias("login"), name.alias("name"),
                              F.concat(login, F.lit(".example.com")).alias("blog"),
                              F.col("c_mktsegment").alias("bio"),
                              F.concat(F.lit("https://code.example.com/"), login).alias("html_url"),
                              F.col("c_nationkey").cast("long").alias("public_repos"),
                              F.floor("c_acctbal").cast("long").alias("followers")))
    recs = c.select("c_custkey", body.alias("body"))
    return X.org_to_company(recs)


def _responses(spark, sf):
    d = T.read_table(spark, sf, "documents")
    lines = F.split(F.col("text"), "\n")
    host = lambda i: F.when(i % 7 == 3, F.lit("https://jobs.lever.co/")).otherwise(F.lit("https://r.example.com/"))
    items = F.transform(lines, lambda l, i: F.struct(
        F.concat(host(i), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string")).alias("link"),
        F.when(i % 7 == 5, F.concat(l, F.lit(" Powered by Greenhouse"))).otherwise(l).alias("title"),
        F.when(F.length(l) > 60, l).alias("snippet")))
    return d.select("doc_id", F.to_json(F.struct(items.alias("organic_results"))).alias("body"))


_RESULTS_SQL = """
res AS (
  SELECT doc_id, i AS rank, concat(CASE WHEN (i - 1) % 7 = 3 THEN 'https://jobs.lever.co/' ELSE 'https://r.example.com/' END,
                CAST(doc_id AS VARCHAR), '/', CAST(i - 1 AS VARCHAR)) AS url,
         CASE WHEN (i - 1) % 7 = 5 THEN concat(line, ' Powered by Greenhouse') ELSE line END AS title, coalesce(CASE WHEN length(line) > 60 THEN line END, '') AS snippet
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""


@query("result_rows", ids=("I13", "E4", "F8", "A16"), sql=with_sql(_RESULTS_SQL) + """
SELECT doc_id, url, title, snippet, CAST(rank AS INTEGER) AS rank FROM res""")
def result_rows(spark, sf):
    return X.result_rows(_responses(spark, sf))


_TAG = G.ats_case("url", "title")


@query("tag_results", ids=("I14", "H13", "H14"), sql=with_sql(_RESULTS_SQL) + f"""
SELECT doc_id, CAST(rank AS INTEGER) AS rank, {_TAG[0]} AS is_ats, {_TAG[1]} AS ats_platform,
       {_TAG[2]} AS confidence, 1 AS priority FROM res""")
def tag_results(spark, sf):
    rows = X.result_rows(_responses(spark, sf))
    return X.tag_results(rows, "url", "title").select("doc_id", "rank", "is_ats", "ats_platform", "confidence",
                                                      "priority")


# ---------------------------------------------------------------- queue, dork results, campaigns, dispatch


@query("retry_queue", ids=("B26", "F9"), sql=with_sql(QUEUE_SQL) + """
SELECT id, url_id, priority, retry_count, created_at FROM queue
WHERE status = 'pending' AND retry_count < max_retries
ORDER BY priority DESC NULLS FIRST, created_at ASC NULLS FIRST, id""")
def retry_queue(spark, sf):
    q = L.dequeue_order(L.retryable(T.crawl_queue(spark, sf)))
    return q.select("id", "url_id", "priority", "retry_count", "created_at")


@query("dork_unprocessed", ids=("B27",), sql=with_sql(_RESULTS_SQL) + """
SELECT doc_id, CAST(rank AS INTEGER) AS rank, sha256(url) AS url_hash FROM res WHERE NOT (rank <= 10)""")
def dork_unprocessed(spark, sf):
    rows = X.result_rows(_responses(spark, sf)).withColumn("processed", F.col("rank") <= 10)
    return X.unprocessed(rows).select("doc_id", "rank", S.url_hash("url").alias("url_hash"))


@query("campaigns", ids=("D14",), sql=with_sql(_RESULTS_SQL) + """
SELECT d.source AS campaign, CAST(count(*) AS INTEGER) AS total_results,
       CAST(count(DISTINCT r.doc_id) AS INTEGER) AS companies_found, CAST(count(DISTINCT r.url) AS INTEGER) AS urls_found
FROM res r JOIN documents d ON r.doc_id = d.doc_id GROUP BY d.source""")
def campaigns(spark, sf):
    rows = X.result_rows(_responses(spark, sf))
    src = T.read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("campaign"))
    return X.campaign_summary(rows.join(src, "doc_id"), "campaign", "doc_id", "url")


@query("discover_companies", ids=("L3", "G1", "G4", "B22"), sql=with_sql(W.PAGE_HOSTS_SQL) + """
SELECT 'github' AS source, CASE WHEN c_acctbal < 500 THEN lower(replace(c_name, '#', '-')) ELSE c_name END AS name,
       concat(lower(replace(c_name, '#', '-')), '.example.com') AS domain FROM customer
UNION ALL
SELECT 'manual', domain, domain FROM (SELECT DISTINCT domain FROM ph)""")
def discover_companies(spark, sf):
    readers = {
        "github": lambda: org_to_company(spark, sf).select("name", "domain"),
        "manual": lambda: W.page_hosts(spark, sf).select("domain").distinct().select(
            F.col("domain").alias("name"), "domain"),
    }
    return X.dispatch_sources(readers, ["github", "manual"]).select("source", "name", "domain")


@query("org_searches", ids=("G4", "F8"), sql="""
SELECT search_id, c_custkey, name FROM (
  SELECT 1 AS search_id, c_custkey, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL
  SELECT 2, c_custkey, c_name FROM customer WHERE c_acctbal > 5000)""")
def org_searches(spark, sf):
    """Two organisation searches concatenated without dedupe (an org found
    by both appears twice), each already capped by its own result limit in
    the source; here each search returns all its matches."""
    c = T.read_table(spark, sf, "customer")
    s1 = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.lit(1).alias("search_id"), "c_custkey", F.col("c_name").alias("name"))
    s2 = c.filter(F.col("c_acctbal") > 5000).select(F.lit(2).alias("search_id"), "c_custkey", F.col("c_name").alias("name"))
    return s1.unionByName(s2)


@query("query_result_urls", ids=("G5",), sql=with_sql(_RESULTS_SQL) + """
SELECT 'boards' AS query, url, CAST(rank AS INTEGER) AS rank FROM res WHERE contains(url, 'lever.co')
UNION ALL SELECT 'first lines', url, CAST(rank AS INTEGER) FROM res WHERE rank <= 3""")
def query_result_urls(spark, sf):
    rows = X.result_rows(_responses(spark, sf))
    return X.query_result_urls([rows.filter(F.contains("url", F.lit("lever.co"))).withColumn("query", F.lit("boards")),
                                rows.filter("rank <= 3").withColumn("query", F.lit("first lines"))])


@query("dork_queries", ids=("C7",), sql="""
SELECT keyword, CAST(template_id AS INTEGER) AS template_id, replace(tpl, '{kw}', keyword) AS query
FROM (SELECT DISTINCT p_type AS keyword FROM part),
     (SELECT unnest(range(""" + str(len(J.dork_templates())) + """)) AS template_id,
             unnest([""" + ", ".join(G.lit(t) for t in J.dork_templates()) + """]) AS tpl)""")
def dork_queries(spark, sf):
    kws = T.read_table(spark, sf, "part").select(F.col("p_type").alias("keyword")).distinct()
    return J.query_templates(kws, templates=J.dork_templates())
