"""Aggregations (D1-D20). All aggregate partially on the map side before
the shuffle; none collects an unbounded group into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.listing import active_predicate


def global_stats(jobs: DataFrame, as_of, exact_distinct: bool = True, min_score: int = 70,
                 days: int = 90) -> DataFrame:
    """Totals, query-time active count, distinct companies, average score
    (0 on an empty table) and the newest crawl time. ``exact_distinct=False``
    uses a HyperLogLog sketch (the source's approximate distinct), which is
    what a 100 TB run should use: exact distinct needs a full shuffle by key."""
    distinct = (F.count_distinct("company") if exact_distinct
                else F.approx_count_distinct("company"))
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(active_predicate(as_of, min_score, days)).alias("active_jobs"),
        distinct.alias("companies"),
        F.coalesce(F.avg("real_score"), F.lit(0.0)).alias("avg_real_score"),
        F.max("crawled_at").alias("last_crawled_at"),
    )


def breakdowns(jobs: DataFrame) -> DataFrame:
    """D12 (documented): counts by job type, by location, and overall remote
    share — one GROUPING SETS pass (single shuffle) instead of three jobs."""
    g = jobs.groupingSets([["job_type"], ["location"], []], "job_type", "location").agg(
        F.count(F.lit(1)).alias("jobs"),
        (F.avg(F.col("remote").cast("double")) * 100.0).alias("remote_pct"),
        F.grouping_id().alias("gid"))
    dim = (F.when(F.col("gid") == 1, F.lit("job_type")).when(F.col("gid") == 2, F.lit("location"))
           .otherwise(F.lit("all")))
    key = F.coalesce(F.col("job_type"), F.col("location"))
    return g.select(dim.alias("dimension"), key.alias("value"), "jobs", "remote_pct")


def url_distribution(urls: DataFrame) -> DataFrame:
    """Per ATS platform (NULL excluded, '' kept) total/crawled/active
    counts and average confidence, largest first."""
    return (urls.filter(F.col("ats_platform").isNotNull()).groupBy("ats_platform")
            .agg(F.count(F.lit(1)).alias("total_urls"),
                 F.count_if(F.col("crawl_status") == "completed").alias("crawled_urls"),
                 F.count_if(F.col("is_active")).alias("active_urls"),
                 F.avg("confidence").alias("avg_confidence"))
            .orderBy(F.col("total_urls").desc(), F.col("ats_platform")))


def platform_statistics(urls: DataFrame) -> DataFrame:
    """The ``ats_statistics`` table (platform, total, active)."""
    return (urls.filter(F.col("ats_platform").isNotNull()).groupBy(F.col("ats_platform").alias("platform"))
            .agg(F.count(F.lit(1)).cast("int").alias("total_urls"),
                 F.count_if(F.col("is_active")).cast("int").alias("active_urls")))


def platform_histogram(df: DataFrame, platform: str = "ats_platform", is_ats: Column | None = None) -> DataFrame:
    """D3: platform -> count as one map (only ATS hits with a non-empty
    platform). The map has one entry per platform, so it is bounded by the
    number of platforms, not by rows."""
    cond = F.col(platform).isNotNull() & (F.col(platform) != "")
    if is_ats is not None:
        cond = cond & is_ats
    counts = df.filter(cond).groupBy(F.col(platform).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    entries = F.sort_array(F.collect_list(F.struct("k", "v")))
    return counts.agg(F.map_from_entries(entries).alias("histogram"))


def daily_stats(jobs: DataFrame, as_of, min_score: int = 70, days: int = 90) -> DataFrame:
    """Per day and platform totals, active count, score sum+count (the
    mergeable form) and average, postings with a hiring manager."""
    return (jobs.groupBy(F.to_date("posted_at").alias("stat_date"), "source_platform")
            .agg(F.count(F.lit(1)).alias("total_jobs"),
                 F.count_if(active_predicate(as_of, min_score, days)).alias("active_jobs"),
                 F.sum(F.col("real_score").cast("long")).alias("sum_real_score"),
                 F.avg("real_score").alias("avg_real_score"),
                 F.count("hiring_manager_name").alias("jobs_with_manager")))


def merge_daily_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """Merge two partial D4 roll-ups: sums add, the average is re-derived."""
    return (a.unionByName(b).groupBy("stat_date", "source_platform")
            .agg(F.sum("total_jobs").alias("total_jobs"), F.sum("active_jobs").alias("active_jobs"),
                 F.sum("sum_real_score").alias("sum_real_score"),
                 F.sum("jobs_with_manager").alias("jobs_with_manager"))
            .withColumn("avg_real_score", F.col("sum_real_score") / F.col("total_jobs")))


def duplicate_summary(df: DataFrame, key: str = "job_hash", seen: str = "crawled_at",
                      url: str = "source_url", exact: bool = False) -> DataFrame:
    """Per hash first/last seen, occurrences and distinct URLs. The URL list
    itself is kept normalised (see ``duplicate_urls``), never one unbounded array."""
    return (df.groupBy(key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
                                F.count(F.lit(1)).alias("occurrence_count"),
                                (F.count_distinct(url) if exact else F.approx_count_distinct(url))
                                .alias("distinct_urls")))


def duplicate_urls(df: DataFrame, key: str = "job_hash", url: str = "source_url") -> DataFrame:
    """D5 URL list in long form: distinct (hash, url) pairs."""
    return df.select(key, url).distinct()


def pool_stats(pool: DataFrame) -> DataFrame:
    """Totals over a proxy pool state table."""
    return pool.agg(F.count(F.lit(1)).alias("total_proxies"),
                    F.count_if(F.col("is_healthy")).alias("healthy_proxies"),
                    F.count_if(~F.col("is_healthy")).alias("unhealthy_proxies"),
                    F.sum("success_count").cast("long").alias("total_success"),
                    F.sum("fail_count").cast("long").alias("total_fail"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """A batch that errored counts as one failure; otherwise its own
    ok/failed counts add up. total = ok + failed."""
    ok = F.sum(F.when(F.col("batch_error"), F.lit(0)).otherwise(F.col("ok"))).cast("long")
    bad = F.sum(F.when(F.col("batch_error"), F.lit(1)).otherwise(F.col("failed"))).cast("long")
    return (batches.agg(ok.alias("successful"), bad.alias("failed"))
            .withColumn("total_crawled", F.col("successful") + F.col("failed")))


def count_rows(df: DataFrame, name: str = "jobs_total") -> DataFrame:
    """Row-count gauge."""
    return df.agg(F.count(F.lit(1)).alias(name))
