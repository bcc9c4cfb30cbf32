"""Filters, projections, paging and point lookups over the postings table
(B1-B4, B7, B24-B28, F1-F3, F6-F10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions import scalars as S

LIST_COLUMNS = ["id", "title", "company", "location", "remote", "salary_min", "salary_max",
                "currency", "real_score", "source_platform", "posted_at"]


def list_filter(jobs: DataFrame, min_score=70, company: str | None = None,
                location: str | None = None) -> DataFrame:
    """Conjunctive list filter; an empty string means "not set".

    ``min_score`` that does not parse as a number matches nothing."""
    try:
        score = int(str(min_score).strip())
        cond = F.col("real_score") >= F.lit(score)
    except ValueError:
        cond = F.lit(False)
    df = jobs.filter(cond)
    if company:
        df = df.filter(F.col("company") == F.lit(company))
    if location:
        df = df.filter(F.col("location") == F.lit(location))
    return df


def list_projection(jobs: DataFrame) -> DataFrame:
    """The 11 list columns; the flag becomes a boolean, the time text."""
    return jobs.select(
        "id", "title", "company", "location", (F.col("remote") == 1).alias("remote"),
        "salary_min", "salary_max", "currency", "real_score", "source_platform",
        S.ts_text("posted_at").alias("posted_at"))


def _to_int(x, default: int) -> int | None:
    try:
        return int(str(x).strip())
    except ValueError:
        return None
    except TypeError:
        return default


def page(df: DataFrame, order: list, limit=20, offset=0) -> DataFrame:
    """Sort + offset + limit. Unparsable limit/offset give 0 rows (the source
    silently turns them into 0). The order must be total (end with a key)."""
    lim, off = _to_int(limit, 20), _to_int(offset, 0)
    if lim is None or off is None:
        return df.limit(0)
    out = df.orderBy(*order)
    if off:
        out = out.offset(off)
    return out.limit(lim)


def newest_first() -> list:
    return [F.col("posted_at").desc_nulls_last(), F.col("id").asc()]


def list_newest(jobs: DataFrame, limit=20, offset=0, min_score=70, company=None, location=None) -> DataFrame:
    """B1 + B7 + F1: filtered, newest-first page of the list projection."""
    filtered = list_filter(jobs, min_score, company, location)
    return list_projection(page(filtered, newest_first(), limit, offset))


def list_newest_fk(fact: DataFrame, enrich, limit=20, offset=0, min_score=70) -> DataFrame:
    """B1 + B7 + F1 when the list needs no dimension filter: the newest-first
    page is taken on the fact table alone (a top-k, no shuffle), and only
    those at most ``offset + limit`` rows are joined to the dimensions.

    Exact only when ``enrich`` is a foreign-key join that keeps every fact row
    exactly once (each posting has one owner); with company or location
    filters use ``list_newest`` on the joined table. The page is bounded by
    ``limit``, so it is broadcast."""
    top = page(list_filter(fact, min_score), newest_first(), limit, offset)
    # at most ``limit`` rows: one partition keeps them in page order without a shuffle
    return (list_projection(enrich(F.broadcast(top))).coalesce(1)
            .sortWithinPartitions(F.col("posted_at").desc(), F.col("id")))


def page_info(jobs: DataFrame, limit=20, offset=0, **filters) -> DataFrame:
    """total matches and whether another page follows (one row)."""
    lim, off = _to_int(limit, 20) or 0, _to_int(offset, 0) or 0
    return (list_filter(jobs, **filters).agg(F.count(F.lit(1)).alias("total"))
            .select("total", (F.lit(off + lim) < F.col("total")).alias("has_more")))


DETAIL_COLUMNS = ["id", "job_hash", "title", "company", "description", "location", "remote",
                  "salary_min", "salary_max", "currency", "job_type", "experience_level",
                  "real_score", "hiring_manager_name", "hiring_manager_email", "source_url",
                  "source_platform", "tags", "posted_at", "crawled_at"]


def get_by_id(jobs: DataFrame, job_id, columns: list[str] | None = None) -> DataFrame:
    """B2: point lookup, at most one row, timestamps as text."""
    cols = [c for c in (columns or DETAIL_COLUMNS) if c in jobs.columns]
    sel = [S.ts_text(c).alias(c) if c in ("posted_at", "crawled_at", "updated_at")
           else ((F.col(c) == 1).alias(c) if c == "remote" else F.col(c)) for c in cols]
    return jobs.filter(F.col("id") == F.lit(job_id)).limit(1).select(*sel)


def active_predicate(as_of, min_score: int = 70, days: int = 90):
    """Score gate and posted within ``days`` of ``as_of`` (never now())."""
    return (F.col("real_score") >= min_score) & (F.col("posted_at") >= S.days_before(as_of, days))


def active_filter(jobs: DataFrame, as_of, min_score: int = 70, days: int = 90,
                  partition_col: str | None = None) -> DataFrame:
    """Query-time active postings. With a month-partitioned table pass its
    ``partition_col`` (``yyyyMM`` text) so the scan prunes old months."""
    df = jobs.filter(active_predicate(as_of, min_score, days))
    if partition_col and partition_col in jobs.columns:
        df = df.filter(F.col(partition_col) >= S.year_month(S.days_before(as_of, days)))
    return df


def stale_filter(companies: DataFrame, as_of, days: int) -> DataFrame:
    """Active companies never crawled or last crawled more than ``days`` ago."""
    ts = F.col("last_crawled_at")
    return companies.filter(F.col("is_active") & (ts.isNull() | (ts < S.days_before(as_of, days))))


def stalest(companies: DataFrame, as_of, days: int = 7, n: int | None = None) -> DataFrame:
    """the ``n`` stalest active companies (without ``n``: all that are due), never-crawled first."""
    due = stale_filter(companies, as_of, days).orderBy(F.col("last_crawled_at").asc_nulls_first(), F.col("id").asc())
    return due if n is None else due.limit(n)


def touch_crawled(companies: DataFrame, keys: DataFrame, as_of, key: str = "id") -> DataFrame:
    """Set ``last_crawled_at = as_of`` for the given company keys."""
    k = keys.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    out = companies.join(k, companies[key] == k["__k"], "left")
    return out.withColumn("last_crawled_at",
                          F.when(F.col("__hit"), S.clock(as_of))
                          .otherwise(F.col("last_crawled_at"))).drop("__k", "__hit")


def search_filter(jobs: DataFrame, remote: bool | None = None, job_type: str | None = None,
                  salary_min: int | None = None, salary_max: int | None = None,
                  posted_after=None, quality_min: int | None = None) -> DataFrame:
    """B24 (documented filters): conjunction of the optional structured filters."""
    df = jobs
    if remote is not None:
        df = df.filter((F.col("remote") == 1) == F.lit(bool(remote)))
    if job_type:
        df = df.filter(F.col("job_type") == job_type)
    if salary_min is not None:
        df = df.filter(F.col("salary_min") >= salary_min)
    if salary_max is not None:
        df = df.filter(F.col("salary_max") <= salary_max)
    if posted_after is not None:
        df = df.filter(F.col("posted_at") >= S.clock(posted_after))
    if quality_min is not None:
        df = df.filter(F.col("real_score") >= quality_min)
    return df


def quality_gate(jobs: DataFrame, min_score: int = 70) -> DataFrame:
    """B25 (documented): score gate plus required title/company/url."""
    return jobs.filter((F.col("real_score") >= min_score) & F.col("title").isNotNull()
                       & F.col("company").isNotNull() & F.col("source_url").isNotNull())


def retryable(queue: DataFrame) -> DataFrame:
    """Pending queue rows that still have retries left."""
    return queue.filter((F.col("status") == "pending") & (F.col("retry_count") < F.col("max_retries")))


def dequeue_order(queue: DataFrame) -> DataFrame:
    """queue order priority DESC, created ASC (id breaks ties)."""
    return queue.orderBy(F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_first(),
                         F.col("id").asc())


def sort_by(df: DataFrame, field: str = "posted_at", descending: bool = True) -> DataFrame:
    """parametrised sort with an id tiebreak."""
    c = F.col(field)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col("id").asc())
