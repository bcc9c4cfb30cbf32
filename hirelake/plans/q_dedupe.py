"""Queries: keyed dedupe, duplicates, health state, event roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import scalars as S
from hirelake.operators import aggregates as A
from hirelake.operators import dedupe as D
from hirelake.operators import health as H
from hirelake.operators import sequence as Q
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources import web as W
from hirelake.sources.tables import with_sql


@query("latest_version", ids=("E1", "A9", "T1", "T2"), sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def latest_version(spark, sf):
    e = T.read_table(spark, sf, "events")
    out = D.latest_version(e, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("event_id", "ts", "user_id", "event_type", "value", "props")


_DOCS_SQL = "d AS (SELECT doc_id, sha256(text) AS text_hash, lang, source FROM documents)"


def _docs(spark, sf):
    d = T.read_table(spark, sf, "documents")
    return d.select("doc_id", S.url_hash("text").alias("text_hash"), "lang", "source")


@query("dedup_hash", ids=("E9", "G7", "H1"), sql=with_sql(_DOCS_SQL) + """
SELECT text_hash, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
FROM d GROUP BY text_hash""")
def dedup_hash(spark, sf):
    return D.dedup_by_hash(_docs(spark, sf), "text_hash", "doc_id").select("text_hash", "doc_id", "lang", "source")


@query("duplicates", ids=("D5", "T16"), sql=with_sql(_DOCS_SQL) + """
SELECT text_hash, min(doc_id) AS first_seen, max(doc_id) AS last_seen, count(*) AS occurrence_count,
       count(DISTINCT source) AS distinct_urls
FROM d GROUP BY text_hash""")
def duplicates(spark, sf):
    return A.duplicate_summary(_docs(spark, sf), key="text_hash", seen="doc_id", url="source", exact=True)


@query("duplicate_urls", ids=("D5",), sql=with_sql(_DOCS_SQL) + """
SELECT DISTINCT text_hash, source FROM d WHERE text_hash IN (
  SELECT text_hash FROM d GROUP BY text_hash HAVING count(*) > 1)""")
def duplicate_urls(spark, sf):
    d = _docs(spark, sf)
    multi = d.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_hash")
    return A.duplicate_urls(d.join(multi, "text_hash", "left_semi"), key="text_hash", url="source")


@query("seen_window", ids=("E10",), sql=with_sql(_DOCS_SQL) + """
SELECT doc_id, text_hash, min(doc_id) OVER (PARTITION BY text_hash) AS first_seen,
       max(doc_id) OVER (PARTITION BY text_hash) AS last_seen FROM d""")
def seen_window(spark, sf):
    return D.seen_window(_docs(spark, sf).select("doc_id", "text_hash"), "text_hash", "doc_id")


_HEALTH_SQL = """
ev AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS s, event_type = 'error' AS f
       FROM events WHERE event_type IN ('purchase', 'error')),
last AS (SELECT user_id, count(*) FILTER (WHERE s) AS success_count,
                max(CASE WHEN s THEN ts END) AS lts FROM ev GROUP BY user_id),
lastid AS (SELECT e.user_id, max(e.event_id) AS leid FROM ev e JOIN last l ON e.user_id = l.user_id
           WHERE e.s AND e.ts = l.lts GROUP BY e.user_id),
fails AS (SELECT e.user_id, count(*) AS fail_count FROM ev e
          JOIN last l ON e.user_id = l.user_id LEFT JOIN lastid i ON e.user_id = i.user_id
          WHERE e.f AND (l.lts IS NULL OR e.ts > l.lts OR (e.ts = l.lts AND e.event_id > i.leid))
          GROUP BY e.user_id),
pool AS (SELECT l.user_id, CAST(l.success_count AS BIGINT) AS success_count,
                CAST(coalesce(f.fail_count, 0) AS BIGINT) AS fail_count, coalesce(f.fail_count, 0) < 3 AS is_healthy
         FROM last l LEFT JOIN fails f ON l.user_id = f.user_id)"""


def _health(spark, sf):
    e = T.read_table(spark, sf, "events")
    return H.health_fold(e, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase",
                         F.col("event_type") == "error")


@query("health_fold", ids=("E7", "K4", "T17"), sql=with_sql(_HEALTH_SQL) + "SELECT * FROM pool")
def health_fold(spark, sf):
    return _health(spark, sf)


@query("pool_stats", ids=("D7", "B28"), sql=with_sql(_HEALTH_SQL) + """
SELECT count(*) AS total_proxies, count(*) FILTER (WHERE is_healthy) AS healthy_proxies,
       count(*) FILTER (WHERE NOT is_healthy) AS unhealthy_proxies,
       CAST(sum(success_count) AS BIGINT) AS total_success, CAST(sum(fail_count) AS BIGINT) AS total_fail
FROM pool""")
def pool_stats(spark, sf):
    return A.pool_stats(_health(spark, sf))


@query("distinct_domains", ids=("D16", "D10"), sql=with_sql(W.PAGE_HOSTS_SQL) + """
SELECT domain, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM ph GROUP BY domain""")
def distinct_domains(spark, sf):
    ph = W.page_hosts(spark, sf).select("domain", "page_id", "url")
    return D.keep_first(ph, ["domain"], ["page_id"]).select("domain", "page_id", "url")


@query("pages_by_domain", ids=("D17", "D10"), sql=with_sql(W.PAGE_HOSTS_SQL) + """
SELECT domain, count(*) AS n_pages, count(DISTINCT host) AS n_hosts, min(url) AS first_url FROM ph GROUP BY domain""")
def pages_by_domain(spark, sf):
    ph = W.page_hosts(spark, sf)
    return ph.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("host").alias("n_hosts"),
                                    F.min("url").alias("first_url"))


# ---------------------------------------------------------------- event roll-ups

_HOURS_SQL = """
b AS (SELECT date_trunc('hour', ts) AS batch, count(*) FILTER (WHERE event_type <> 'error') AS ok,
             count(*) FILTER (WHERE event_type = 'error') AS failed,
             count(*) FILTER (WHERE event_type = 'view') = 0 AS batch_error
      FROM events GROUP BY 1)"""


@query("crawl_totals", ids=("D8", "T17"), sql=with_sql(_HOURS_SQL) + """
SELECT CAST(sum(CASE WHEN batch_error THEN 0 ELSE ok END) AS BIGINT) AS successful,
       CAST(sum(CASE WHEN batch_error THEN 1 ELSE failed END) AS BIGINT) AS failed,
       CAST(sum(CASE WHEN batch_error THEN 0 ELSE ok END) + sum(CASE WHEN batch_error THEN 1 ELSE failed END) AS BIGINT) AS total_crawled
FROM b""")
def crawl_totals(spark, sf):
    e = T.read_table(spark, sf, "events")
    b = e.groupBy(F.date_trunc("hour", "ts").alias("batch")).agg(
        F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("failed"),
        (F.count_if(F.col("event_type") == "view") == 0).alias("batch_error"))
    return A.batch_totals(b)


@query("crawl_history", ids=("D9", "A14"), sql="""
SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS crawl_id, 'events' AS source_platform,
       min(ts) AS start_time, max(ts) AS end_time, CAST(count(*) AS INTEGER) AS total_jobs_found,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS INTEGER) AS jobs_inserted,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS INTEGER) AS jobs_updated,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS INTEGER) AS jobs_failed,
       CASE WHEN count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'purchase')
            THEN 'failed' ELSE 'completed' END AS status
FROM events GROUP BY CAST(ts AS DATE)""")
def crawl_history(spark, sf):
    e = T.read_table(spark, sf, "events")
    g = e.groupBy(F.to_date("ts").alias("d")).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count(F.lit(1)).cast("int").alias("total_jobs_found"),
        F.count_if(F.col("event_type") == "purchase").cast("int").alias("jobs_inserted"),
        F.count_if(F.col("event_type") == "click").cast("int").alias("jobs_updated"),
        F.count_if(F.col("event_type") == "error").cast("int").alias("jobs_failed"))
    return g.select(F.date_format("d", "yyyyMMdd").alias("crawl_id"), F.lit("events").alias("source_platform"),
                    "start_time", "end_time", "total_jobs_found", "jobs_inserted", "jobs_updated", "jobs_failed",
                    F.when(F.col("jobs_failed") > F.col("jobs_inserted"), "failed").otherwise("completed").alias("status"))


@query("rates", ids=("D15",), sql="""
SELECT CAST(ts AS DATE) AS day, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) AS success_rate,
       count(*) FILTER (WHERE event_type = 'purchase') AS postings
FROM events GROUP BY 1""")
def rates(spark, sf):
    e = T.read_table(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.round(F.avg(F.when(F.col("event_type") == "error", 0.0).otherwise(1.0)), 6).alias("success_rate"),
        F.count_if(F.col("event_type") == "purchase").alias("postings"))


def _response_line():
    return (F.when(F.col("event_type") == "error", F.lit('{"success": false, "error": "rejected"}'))
            .when(F.col("event_type") == "view", F.substr("props", F.lit(2)))
            .otherwise(F.lit('{"success": true}')))


@query("import_tally", ids=("A10",), sql="""
SELECT count(*) FILTER (WHERE ok) AS n_success, count(*) FILTER (WHERE NOT ok) AS n_error FROM (
  SELECT coalesce(CASE WHEN json_valid(line) THEN TRY_CAST(json_extract_string(line, '$.success') AS BOOLEAN) END, false) AS ok
  FROM (SELECT CASE event_type WHEN 'error' THEN '{"success": false, "error": "rejected"}'
                               WHEN 'view' THEN substr(props, 2) ELSE '{"success": true}' END AS line FROM events))""")
def import_tally(spark, sf):
    e = T.read_table(spark, sf, "events")
    from hirelake.operators.export import import_tally as tally
    return tally(e.select(_response_line().alias("line")), "line")
