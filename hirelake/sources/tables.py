"""Readers for the given parquet tables and the derived views that put the
posting-pipeline data model (postings, discovered URLs, companies, crawl
queue, fetch log) on top of them.

Every Spark view here has a DuckDB twin (``*_SQL``) used as a CTE by the
oracle SQL, so the two sides share one definition of the binding. Derived
columns come from row values (prices, balances, statuses), never from id
subsets: every view covers its whole source tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import scalars as S

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# Fixed clocks of the fixtures (operators never read the wall clock).
AS_OF_ORDERS = "2001-08-02 00:00:00"
AS_OF_EVENTS = "2024-01-31 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None) -> DataFrame:
    """Scan of a given table; ``partitions`` asks for that many task inputs
    (a round-robin shuffle), by default the scan's own splits are used."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(partitions) if partitions else df


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` is read from; 0 for made-up rows."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(name))
        total += place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
    return total


def parts(n_bytes: int, mb: int, least: int) -> int:
    """A number of partitions that grows with the bytes, ``mb`` to each."""
    return max(least, math.ceil(n_bytes / (mb * 1024 * 1024)))


def spread(df: DataFrame, mb: int | None = None) -> DataFrame:
    """A plain scan before heavy work per row: a file of one row group is one
    task, however many cores there are. Such a small scan is dealt over all of
    them; a scan with as many splits as cores stays as it is. With ``mb`` no
    partition has more than about so many MB of the files, for work whose
    memory grows with a task's rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = parts(input_bytes(df), mb, cores) if mb else cores
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def bounded_dim(df: DataFrame) -> DataFrame:
    """Broadcast hint for dimensions whose size is fixed by the data model
    (nation: 25 rows, region: 5 rows), independent of scale."""
    return F.broadcast(df)


# ---------------------------------------------------------------- postings (jobs table)

POSTING_FACT_COLUMNS = ["id", "o_custkey", "remote", "job_type", "real_score", "source_platform", "posted_at",
                        "updated_at", "crawled_at", "version"]


def postings_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-side columns of the postings: everything a list filter and
    the newest-first order need, from one table."""
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), "o_custkey",
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("remote"),
        F.col("o_orderstatus").alias("job_type"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("real_score"),
        F.col("o_orderpriority").alias("source_platform"),
        F.col("o_orderdate").alias("posted_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("updated_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("crawled_at"),
        F.lit(1).cast("long").alias("version"),
    )


def enrich_postings(fact: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the customer/nation-side columns to posting fact rows. Every order
    has exactly one customer and every customer one nation (foreign keys), so
    this inner join keeps each fact row exactly once."""
    c = read_table(spark, sf_dir, "customer")
    n = bounded_dim(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = fact.join(c, fact.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    has_salary = F.col("c_acctbal") > 0
    smin = F.when(has_salary, F.floor("c_acctbal").cast("int"))
    url = F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.com/jobs/"), F.col("id").cast("string"))
    return j.select(
        "id",
        S.job_hash(url, F.col("c_name"), F.col("c_mktsegment")).alias("job_hash"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("company"),
        F.col("n_name").alias("location"),
        "remote",
        smin.alias("salary_min"),
        (smin + F.lit(20000)).alias("salary_max"),
        F.when(has_salary, F.lit("USD")).alias("currency"),
        "job_type",
        F.when(F.col("c_acctbal") > 5000, F.lit("senior")).alias("experience_level"),
        "real_score",
        F.when(F.col("c_acctbal") >= 1000, F.col("c_name")).alias("hiring_manager_name"),
        url.alias("source_url"),
        "source_platform",
        F.array(F.lower("c_mktsegment"), F.lower("n_name")).alias("tags"),
        "posted_at", "updated_at", "crawled_at", "version",
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``jobs`` table: one posting per order, owned by the order's customer."""
    return enrich_postings(postings_fact(spark, sf_dir), spark, sf_dir)


POSTINGS_SQL = """
jobs AS (
  SELECT o.o_orderkey AS id,
         sha256(concat('https://', lower(c.c_mktsegment), '.example.com/jobs/', CAST(o.o_orderkey AS VARCHAR),
                       c.c_name, c.c_mktsegment)) AS job_hash,
         c.c_name AS title,
         c.c_mktsegment AS company,
         n.n_name AS location,
         CAST(o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS remote,
         CASE WHEN c.c_acctbal > 0 THEN CAST(floor(c.c_acctbal) AS INTEGER) END AS salary_min,
         CASE WHEN c.c_acctbal > 0 THEN CAST(floor(c.c_acctbal) AS INTEGER) + 20000 END AS salary_max,
         CASE WHEN c.c_acctbal > 0 THEN 'USD' END AS currency,
         o.o_orderstatus AS job_type,
         CASE WHEN c.c_acctbal > 5000 THEN 'senior' END AS experience_level,
         CAST(floor(o.o_totalprice / 5000) AS INTEGER) AS real_score,
         CASE WHEN c.c_acctbal >= 1000 THEN c.c_name END AS hiring_manager_name,
         concat('https://', lower(c.c_mktsegment), '.example.com/jobs/', CAST(o.o_orderkey AS VARCHAR)) AS source_url,
         o.o_orderpriority AS source_platform,
         o.o_orderdate AS posted_at,
         o.o_orderdate + INTERVAL 1 DAY AS updated_at,
         o.o_orderdate + INTERVAL 1 DAY AS crawled_at
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


# ---------------------------------------------------------------- discovered URLs / companies / queue

def _domain(segment, nation_name):
    return F.concat(F.lower(segment), F.lit("-"), F.lower(F.replace(nation_name, F.lit(" "), F.lit("-"))),
                    F.lit(".example.com"))


_DOMAIN_SQL = "concat(lower({s}), '-', lower(replace({n}, ' ', '-')), '.example.com')"


def discovered_urls(spark: SparkSession, sf_dir: str, with_domain: bool = False) -> DataFrame:
    """``discovered_urls``: one candidate URL per order. ``with_domain`` adds the
    owning company's domain and a domain-based URL (needs the customer join)."""
    o = read_table(spark, sf_dir, "orders")
    cols = [
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.when(F.col("o_orderstatus") == "F", "careers").when(F.col("o_orderstatus") == "O", "jobs")
        .otherwise("subdomain").alias("page_type"),
        (F.col("o_totalprice") / 1000000.0).alias("confidence"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
        .otherwise(F.lower(F.substr("o_orderpriority", F.lit(3)))).alias("ats_platform"),
        F.lit("osint").alias("discovered_via"),
        F.col("o_orderdate").alias("discovered_at"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("failed").alias("crawl_status"),
        F.floor(F.col("o_totalprice") / 50000).cast("int").alias("priority"),
        (F.col("o_totalprice") >= 20000).alias("is_active"),
    ]
    if not with_domain:
        url = F.concat(F.lit("https://jobs.example.com/"), F.col("o_orderkey").cast("string"))
        return o.select(*cols, url.alias("url"), S.url_hash(url).alias("url_hash"))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = bounded_dim(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    dom = _domain(F.col("c_mktsegment"), F.col("n_name"))
    url = F.concat(F.lit("https://"), dom, F.lit("/jobs/"), F.col("o_orderkey").cast("string"))
    return j.select(*cols, dom.alias("domain"), url.alias("url"), S.url_hash(url).alias("url_hash"))


URLS_SQL = """
urls AS (
  SELECT o_orderkey AS id, o_custkey AS company_id,
         CASE o_orderstatus WHEN 'F' THEN 'careers' WHEN 'O' THEN 'jobs' ELSE 'subdomain' END AS page_type,
         o_totalprice / 1000000.0 AS confidence,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
              ELSE lower(substr(o_orderpriority, 3)) END AS ats_platform,
         'osint' AS discovered_via,
         o_orderdate AS discovered_at,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'failed' END AS crawl_status,
         CAST(floor(o_totalprice / 50000) AS INTEGER) AS priority,
         o_totalprice >= 20000 AS is_active,
         concat('https://jobs.example.com/', CAST(o_orderkey AS VARCHAR)) AS url
  FROM orders
)"""

URLS_DOMAIN_SQL = """
urls_d AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS company_id,
         """ + _DOMAIN_SQL.format(s="c.c_mktsegment", n="n.n_name") + """ AS domain
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``companies``: one per customer, several per domain. Only those
    with a large balance have a site of their own; so some domains find
    several companies and some none."""
    c = read_table(spark, sf_dir, "customer")
    n = bounded_dim(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 9000, _domain(F.col("c_mktsegment"), F.col("n_name"))).alias("domain"),
        F.col("c_mktsegment").alias("industry"),
        F.lit("seed").alias("source"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


COMPANIES_SQL = """
companies AS (
  SELECT c.c_custkey AS id, c.c_name AS name,
         CASE WHEN c.c_acctbal >= 9000 THEN """ + _DOMAIN_SQL.format(s="c.c_mktsegment", n="n.n_name") + """ END AS domain,
         c.c_mktsegment AS industry, 'seed' AS source, c.c_acctbal >= 0 AS is_active
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""


def company_last_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last completed crawl per company = latest fulfilled order (NULL if none)."""
    o = read_table(spark, sf_dir, "orders")
    last = (o.groupBy(F.col("o_custkey").alias("id"))
            .agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last_crawled_at")))
    return companies(spark, sf_dir).join(last, "id", "left")


COMPANY_CRAWL_SQL = """
last_crawl AS (
  SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS last_crawled_at
  FROM orders GROUP BY o_custkey
),
companies_c AS (
  SELECT c.*, l.last_crawled_at FROM companies c LEFT JOIN last_crawl l ON c.id = l.id
)"""


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``crawl_queue``: one queue row per event; url_id is unique."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("url_id"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed")
        .otherwise("pending").alias("status"),
        F.floor(F.col("value") / 20).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.col("ts").alias("created_at"),
        F.floor(F.col("value")).cast("int").alias("priority"),
    )


QUEUE_SQL = """
queue AS (
  SELECT event_id AS id, event_id AS url_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status,
         CAST(floor(value / 20) AS INTEGER) AS retry_count,
         3 AS max_retries,
         ts AS created_at,
         CAST(floor(value) AS INTEGER) AS priority
  FROM events
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
