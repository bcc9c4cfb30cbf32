"""Web-side views derived from ``pages`` and ``documents``: page hosts,
certificate-log style host lists, harvested host lists, fetch logs of
career-page candidates. Each Spark builder has a DuckDB twin (``*_SQL``).

These replace the source's live network calls: the responses become rows
derived from the given tables, so their size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import scalars as S
from hirelake.operators.discovery import site_domain
from hirelake.sources.tables import read_table

HOST_SQL = ("lower(regexp_replace(regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1),"
            " '^.*@', ''), ':[0-9]*$', ''))")
SITE_SQL = "regexp_replace({h}, '^(www|m|blog)\\.', '')"


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    h = S.url_host("url")
    return p.select("page_id", "url", h.alias("host"), site_domain(h).alias("domain"),
                    F.regexp_extract(S.url_path("url"), r"^/([^/]*)", 1).alias("seg1"))


PAGE_HOSTS_SQL = """
ph AS (
  SELECT page_id, url, host, """ + SITE_SQL.format(h="host") + """ AS domain,
         regexp_extract(path, '^/([^/]*)', 1) AS seg1
  FROM (SELECT page_id, url, """ + HOST_SQL.format(u="url") + """ AS host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
        FROM pages)
)"""


def ct_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate-log entry per page: wildcard of the site domain, the
    page host (padded), a language sub-host, a job host and a host of another
    domain, newline separated."""
    h = page_hosts(spark, sf_dir)
    nv = F.concat(F.lit("*."), F.col("domain"), F.lit("\n "), F.col("host"), F.lit(" \n"),
                  F.lower("seg1"), F.lit("."), F.col("domain"), F.lit("\ncareers."), F.col("domain"),
                  F.lit("\nother.example.invalid"))
    return h.select("page_id", "domain", nv.alias("name_value"))


CT_ENTRIES_SQL = """
ct AS (
  SELECT page_id, domain,
         concat('*.', domain, chr(10), ' ', host, ' ', chr(10), lower(seg1), '.', domain, chr(10), 'careers.', domain,
                chr(10), 'other.example.invalid') AS name_value
  FROM ph
)"""


def harvested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw harvested host names per page domain, upper-cased and padded: the
    page's host and a job host of the domain."""
    h = page_hosts(spark, sf_dir)
    hosts = F.array(F.col("host"), F.concat(F.lit("jobs."), F.col("domain")))
    return h.select("page_id", "domain", F.explode(F.transform(
        hosts, lambda x: F.concat(F.lit("  "), F.upper(x), F.lit(" ")))).alias("raw_host"))


HARVESTED_SQL = """
hraw AS (
  SELECT page_id, domain, lower(trim(concat('  ', upper(h), ' '))) AS subdomain
  FROM (SELECT page_id, domain, unnest([host, concat('jobs.', domain)]) AS h FROM ph)
)"""


def career_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched career-page candidates: one per document. English/French
    sources are probed as ``careers.<source>`` sub-hosts, the rest as a
    ``/careers/`` path; the body is the document text plus a footer that
    depends on its language; short documents answered 404."""
    d = read_table(spark, sf_dir, "documents")
    sub = F.col("lang").isin("en", "fr")
    url = F.when(sub, F.concat(F.lit("https://careers."), F.col("source"), F.lit(".example.com/"),
                               F.col("doc_id").cast("string"))) \
        .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/careers/"),
                            F.col("doc_id").cast("string")))
    footer = (F.when(F.col("lang") == "en", F.lit(" Join our team: careers, jobs and openings."))
              .when(F.col("lang") == "de", F.lit(" jobs hiring")).when(F.col("lang") == "fr", F.lit(" positions"))
              .otherwise(F.lit("")))
    return d.select("doc_id", url.alias("url"), F.concat(F.col("text"), footer).alias("content"),
                    F.when(F.col("n_chars") < 200, 404).otherwise(200).alias("status"),
                    F.when(sub, F.lit("subdomain")).otherwise(F.lit("path")).alias("kind"))


CAREER_FETCH_SQL = """
cfetch AS (
  SELECT doc_id,
         CASE WHEN lang IN ('en', 'fr') THEN concat('https://careers.', source, '.example.com/', CAST(doc_id AS VARCHAR))
              ELSE concat('https://', source, '.example.com/careers/', CAST(doc_id AS VARCHAR)) END AS url,
         concat(text, CASE lang WHEN 'en' THEN ' Join our team: careers, jobs and openings.'
                                WHEN 'de' THEN ' jobs hiring' WHEN 'fr' THEN ' positions' ELSE '' END) AS content,
         CASE WHEN n_chars < 200 THEN 404 ELSE 200 END AS status,
         CASE WHEN lang IN ('en', 'fr') THEN 'subdomain' ELSE 'path' END AS kind
  FROM documents
)"""


def page_fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch log of the pages: fragment URLs failed with 500, query URLs
    with 404, the rest answered 200."""
    p = read_table(spark, sf_dir, "pages")
    st = (F.when(F.contains("url", F.lit("#")), 500).when(F.contains("url", F.lit("?")), 404)
          .otherwise(200))
    return p.select("page_id", "url", "html", st.alias("status"))


PAGE_FETCH_SQL = """
plog AS (
  SELECT page_id, url, html,
         CASE WHEN contains(url, '#') THEN 500 WHEN contains(url, '?') THEN 404 ELSE 200 END AS status
  FROM pages
)"""
