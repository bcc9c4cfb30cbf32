"""Queries: top-n per group, fixed-size batches, export batches and JSONL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import export as E
from hirelake.operators import sequence as Q
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources.tables import POSTINGS_SQL, with_sql


@query("top_n", ids=("E5", "T17"), sql="""
SELECT l_orderkey, l_linenumber, rn FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn
  FROM lineitem) WHERE rn <= 5""")
def top_n(spark, sf):
    li = T.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return Q.top_n(li, ["l_orderkey"], [F.col("l_linenumber")], 5).select(
        "l_orderkey", "l_linenumber", F.col("rn").cast("bigint").alias("rn"))


@query("batches", ids=("E6",), sql="""
SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, seq,
       CAST(floor(seq / 10) AS BIGINT) AS batch_id FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS seq
  FROM lineitem)""")
def batches(spark, sf):
    li = T.read_table(spark, sf, "lineitem")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    return Q.batches(li, 10, order, group=["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
        "seq", "batch_id")


@query("export_batches", ids=("A8", "F5"), sql=with_sql(POSTINGS_SQL) + """
SELECT id, job_type, source_platform, real_score, CAST(floor((row_number() OVER (ORDER BY posted_at DESC, id) - 1) / 40) AS BIGINT) AS batch_id FROM jobs""")
def export_batches(spark, sf):
    jobs = T.postings_fact(spark, sf)
    return Q.batches(jobs, 40, [F.col("posted_at").desc(), F.col("id")]).select(
        "id", "job_type", "source_platform", "real_score", "batch_id")


_DOC_TYPE = ("id string, title string, company string, location string, remote boolean, salary_min int, salary_max int, "
             "currency string, job_type string, experience_level string, real_score int, hiring_manager_name string, "
             "posted_at long, updated_at long, source_url string, source_platform string, tags array<string>")


@query("export_jsonl", ids=("A7", "A4", "F5"), sql=with_sql(POSTINGS_SQL) + """
SELECT id AS row_id, CAST(id AS VARCHAR) AS id, title, company, location, remote = 1 AS remote, salary_min, salary_max, currency,
       job_type, experience_level, real_score, hiring_manager_name, CAST(epoch(posted_at) AS BIGINT) AS posted_at,
       CAST(epoch(updated_at) AS BIGINT) AS updated_at, source_url, source_platform,
       concat(lower(company), ',', lower(location)) AS tags,
       12 + 3 * CAST(salary_min IS NOT NULL AS INTEGER) + CAST(experience_level IS NOT NULL AS INTEGER)
          + CAST(hiring_manager_name IS NOT NULL AS INTEGER) AS n_keys
FROM jobs""")
def export_jsonl(spark, sf):
    """The lines are written as text files, read back and parsed, field by
    field; ``n_keys`` counts a line's keys (those without a value are left out)."""
    from hirelake.session import scratch_path
    path = scratch_path(spark, "export")
    E.write_jsonl(E.search_documents(T.postings(spark, sf)), path)
    back = spark.read.text(path).select(F.from_json("value", _DOC_TYPE).alias("d"), F.size(F.json_object_keys("value")).alias("n_keys"))
    return back.select(F.col("d.id").cast("long").alias("row_id"), "d.*", "n_keys").withColumn("tags", F.array_join("tags", ","))


@query("sort_by_salary", ids=("F7",), sql=with_sql(POSTINGS_SQL) + """
SELECT id, salary_min FROM jobs ORDER BY salary_min DESC NULLS LAST, id LIMIT 50""")
def sort_by_salary(spark, sf):
    from hirelake.operators import listing as L
    return L.sort_by(T.postings(spark, sf).select("id", "salary_min"), "salary_min").limit(50)
