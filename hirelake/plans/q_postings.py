"""Queries over the postings table: list/page/lookup, stats, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import aggregates as A
from hirelake.operators import listing as L
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources.tables import AS_OF_ORDERS, POSTINGS_SQL, with_sql

_LIST_SELECT = """
SELECT id, title, company, location, remote = 1 AS remote, salary_min, salary_max, currency,
       real_score, source_platform, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at
FROM jobs"""


@query("list_newest", ids=("F1", "B1", "B7", "A1"), sql=with_sql(POSTINGS_SQL) + _LIST_SELECT + """
WHERE real_score >= 70 ORDER BY jobs.posted_at DESC, id LIMIT 20 OFFSET 0""")
def list_newest(spark, sf):
    # no dimension filter: page on the orders alone, then join only the page (foreign keys hold)
    return L.list_newest_fk(T.postings_fact(spark, sf), lambda f: T.enrich_postings(f, spark, sf))


@query("list_filtered", ids=("B1", "F1", "B7"), sql=with_sql(POSTINGS_SQL) + _LIST_SELECT + """
WHERE real_score >= 50 AND company = 'BUILDING'
ORDER BY jobs.posted_at DESC, id LIMIT 10 OFFSET 5""")
def list_filtered(spark, sf):
    # location '' means "not set"
    return L.list_newest(T.postings(spark, sf), limit=10, offset=5, min_score="50",
                         company="BUILDING", location="")


@query("list_by_location", ids=("B1", "F1"), sql=with_sql(POSTINGS_SQL) + _LIST_SELECT + """
WHERE real_score >= 70 AND location = 'NATION_7'
ORDER BY jobs.posted_at DESC, id LIMIT 20 OFFSET 5""")
def list_by_location(spark, sf):
    return L.list_newest(T.postings(spark, sf), limit=20, offset=5, location="NATION_7")


_DETAIL = ["id", "job_hash", "title", "company", "location", "remote", "salary_min", "salary_max",
           "currency", "job_type", "experience_level", "real_score", "hiring_manager_name",
           "source_url", "source_platform", "posted_at", "crawled_at"]


@query("job_by_id", ids=("B2", "H22"), sql=with_sql(POSTINGS_SQL) + """
SELECT id, job_hash, title, company, location, remote = 1 AS remote, salary_min, salary_max, currency,
       job_type, experience_level, real_score, hiring_manager_name, source_url, source_platform,
       strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at,
       strftime(crawled_at, '%Y-%m-%d %H:%M:%S') AS crawled_at
FROM jobs WHERE id = 1234 LIMIT 1""")
def job_by_id(spark, sf):
    return L.get_by_id(T.postings(spark, sf), 1234, _DETAIL)


@query("page_info", ids=("F10", "F6"), sql=with_sql(POSTINGS_SQL) + """
SELECT count(*) AS total, 20 < count(*) AS has_more
FROM jobs WHERE real_score >= 50 AND company = 'BUILDING'""")
def page_info(spark, sf):
    return L.page_info(T.postings(spark, sf), limit=20, offset=0, min_score=50, company="BUILDING")


@query("stats_global", ids=("D1", "B3", "H23", "H24"), sql=with_sql(POSTINGS_SQL) + f"""
SELECT count(*) AS total_jobs,
       count(*) FILTER (WHERE real_score >= 70 AND posted_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY) AS active_jobs,
       count(DISTINCT company) AS companies,
       round(coalesce(avg(real_score), 0), 6) AS avg_real_score,
       max(crawled_at) AS last_crawled_at
FROM jobs""")
def stats_global(spark, sf):
    df = A.global_stats(T.postings(spark, sf), AS_OF_ORDERS)
    return df.withColumn("avg_real_score", F.round("avg_real_score", 6))


@query("active_postings", ids=("B3", "K1"), sql=with_sql(POSTINGS_SQL) + f"""
SELECT id, real_score, posted_at FROM jobs
WHERE real_score >= 70 AND posted_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY""")
def active_postings(spark, sf):
    return L.active_filter(T.postings(spark, sf), AS_OF_ORDERS).select("id", "real_score", "posted_at")


@query("stats_breakdowns", ids=("D12",), sql=with_sql(POSTINGS_SQL) + """
SELECT CASE GROUPING(job_type, location) WHEN 1 THEN 'job_type' WHEN 2 THEN 'location' ELSE 'all' END AS dimension,
       coalesce(job_type, location) AS value,
       count(*) AS jobs,
       round(avg(CAST(remote AS DOUBLE)) * 100.0, 6) AS remote_pct
FROM jobs GROUP BY GROUPING SETS ((job_type), (location), ())""")
def stats_breakdowns(spark, sf):
    return A.breakdowns(T.postings(spark, sf)).withColumn("remote_pct", F.round("remote_pct", 6))


@query("job_stats_daily", ids=("D4", "K2"), sql=with_sql(POSTINGS_SQL) + f"""
SELECT CAST(posted_at AS DATE) AS stat_date, source_platform,
       count(*) AS total_jobs,
       count(*) FILTER (WHERE real_score >= 70 AND posted_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY) AS active_jobs,
       CAST(sum(real_score) AS BIGINT) AS sum_real_score,
       round(avg(real_score), 6) AS avg_real_score,
       count(hiring_manager_name) AS jobs_with_manager
FROM jobs GROUP BY 1, 2""")
def job_stats_daily(spark, sf):
    return A.daily_stats(T.postings(spark, sf), AS_OF_ORDERS).withColumn(
        "avg_real_score", F.round("avg_real_score", 6))


@query("jobs_total", ids=("D11",), sql=with_sql(POSTINGS_SQL) + "SELECT count(*) AS jobs_total FROM jobs")
def jobs_total(spark, sf):
    return A.count_rows(T.postings(spark, sf))


@query("search_filtered", ids=("B24", "B25", "F7"), sql=with_sql(POSTINGS_SQL) + """
SELECT id, real_score, salary_min FROM jobs
WHERE remote = 1 AND job_type = 'O' AND salary_min >= 2000 AND salary_max <= 25000
  AND posted_at >= TIMESTAMP '2000-01-01' AND real_score >= 70
  AND title IS NOT NULL AND company IS NOT NULL AND source_url IS NOT NULL""")
def search_filtered(spark, sf):
    jobs = T.postings(spark, sf)
    df = L.search_filter(jobs, remote=True, job_type="O", salary_min=2000, salary_max=25000,
                         posted_after="2000-01-01")
    return L.quality_gate(df, 70).select("id", "real_score", "salary_min")


@query("active_partitioned", ids=("A6", "B3", "H22", "K6"), sql=with_sql(POSTINGS_SQL) + f"""
SELECT id, real_score, posted_at FROM jobs
WHERE real_score >= 70 AND posted_at >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY""")
def active_partitioned(spark, sf):
    """Postings written month-partitioned (``posted_ym``) to the shared folder,
    read back, and filtered; the month bound derived from ``as_of`` prunes
    whole partitions before any file is opened."""
    from hirelake.operators.store import write_month_partitioned
    from hirelake.session import scratch_path
    path = scratch_path(spark, "jobs-by-month")
    cols = ["id", "real_score", "posted_at", "company", "location"]
    write_month_partitioned(T.postings(spark, sf).select(*cols), path, "posted_at", "posted_ym",
                            sort_cols=["company", "location", "posted_at"], mode="overwrite")
    jobs = spark.read.parquet(path)
    return L.active_filter(jobs, AS_OF_ORDERS, partition_col="posted_ym").select("id", "real_score", "posted_at")
