"""Streaming queries: each runs its plan with ``availableNow`` over the table
staged as time-ordered files, then reads the merged sink; the oracle is the
batch query with the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import scalars as S
from hirelake.operators import html as H
from hirelake.operators import stored
from hirelake.plans.q_documents import _HEUR_SQL
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources.tables import AS_OF_ORDERS, COMPANIES_SQL, COMPANY_CRAWL_SQL, with_sql
from hirelake.streaming import streams as K

N_BATCHES = 4


def _orders_stream(spark, sf):
    o = T.read_table(spark, sf, "orders")
    src = K.staged_stream(o, "o_orderdate", N_BATCHES, "orders")
    return src.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("real_score"),
                      F.col("o_orderdate").alias("posted_at"), F.col("o_orderpriority").alias("source_platform"))


@query("stream_active", ids=("K1", "T3"), sql=f"""
SELECT o_orderkey AS id, CAST(floor(o_totalprice / 5000) AS INTEGER) AS real_score, o_orderdate AS posted_at
FROM orders WHERE floor(o_totalprice / 5000) >= 70 AND o_orderdate >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY""")
def stream_active(spark, sf):
    src = _orders_stream(spark, sf)
    out = K.stream_active(src, AS_OF_ORDERS).select("id", "real_score", "posted_at")
    sink = K.run_available_now(out, "active")
    return K.read_epochs(spark, sink, out.schema).drop("epoch")


@query("stream_rollup", ids=("K2", "D4"), sql=f"""
SELECT CAST(o_orderdate AS DATE) AS stat_date, o_orderpriority AS source_platform, count(*) AS total_jobs,
       count(*) FILTER (WHERE floor(o_totalprice / 5000) >= 70
                        AND o_orderdate >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 90 DAY) AS active_jobs,
       CAST(sum(CAST(floor(o_totalprice / 5000) AS BIGINT)) AS BIGINT) AS sum_real_score
FROM orders GROUP BY 1, 2""")
def stream_rollup(spark, sf):
    agg = K.stream_rollup(_orders_stream(spark, sf), AS_OF_ORDERS)
    sink = K.run_available_now(agg, "rollup", mode="update")
    rows = K.read_epochs(spark, sink, agg.schema)
    return K.latest_by_epoch(rows, ["stat_date", "source_platform"])


def _events_stream(spark, sf):
    e = T.read_table(spark, sf, "events")
    return K.staged_stream(e, "ts", N_BATCHES, "events"), e.schema


@query("stream_latest", ids=("K3", "A9", "E1"), sql="""
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def stream_latest(spark, sf):
    src, schema = _events_stream(spark, sf)
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    sink = K.run_available_now(src, "latest", writer=K.upsert_writer(keys, order, buckets=16))
    return stored.read_upserted(spark, sink, schema).select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("stream_health", ids=("K4", "E7"), sql="""
WITH ev AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS s, event_type = 'error' AS f
            FROM events WHERE event_type IN ('purchase', 'error')),
last AS (SELECT user_id, count(*) FILTER (WHERE s) AS success_count, max(CASE WHEN s THEN ts END) AS lts
         FROM ev GROUP BY user_id),
lastid AS (SELECT e.user_id, max(e.event_id) AS leid FROM ev e JOIN last l ON e.user_id = l.user_id
           WHERE e.s AND e.ts = l.lts GROUP BY e.user_id),
fails AS (SELECT e.user_id, count(*) AS fail_count FROM ev e
          JOIN last l ON e.user_id = l.user_id LEFT JOIN lastid i ON e.user_id = i.user_id
          WHERE e.f AND (l.lts IS NULL OR e.ts > l.lts OR (e.ts = l.lts AND e.event_id > i.leid))
          GROUP BY e.user_id)
SELECT l.user_id, CAST(l.success_count AS BIGINT) AS success_count,
       CAST(coalesce(f.fail_count, 0) AS BIGINT) AS fail_count, coalesce(f.fail_count, 0) < 3 AS is_healthy
FROM last l LEFT JOIN fails f ON l.user_id = f.user_id""")
def stream_health(spark, sf):
    src, _ = _events_stream(spark, sf)
    st = K.stream_health(src, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error")
    sink = K.run_available_now(st, "health", mode="update")
    rows = K.read_epochs(spark, sink, st.schema)
    return K.latest_by_epoch(rows, ["user_id"])


@query("stream_due", ids=("K6",), sql=with_sql(COMPANIES_SQL, COMPANY_CRAWL_SQL) + f"""
SELECT id, last_crawled_at FROM companies_c
WHERE is_active AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 7 DAY)""")
def stream_due(spark, sf):
    """The fulfilled orders are crawls; a tick at the clock's time ends the
    feed. Companies that the feed never names are due, too."""
    o = T.read_table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("long").alias("id"), F.col("o_orderdate").cast("timestamp").alias("crawled_at"))
    tick = spark.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(AS_OF_ORDERS).cast("timestamp").alias("crawled_at"))
    feed = o.unionByName(tick)
    src = K.file_stream(spark, K.stage(feed, "crawled_at", N_BATCHES, "crawls"), feed.schema, files_per_trigger=None)
    states = K.stream_due(src, days=7)
    sink = K.run_available_now(states, "due", mode="update", conf=K.DUE_CONF)
    rows = K.read_epochs(spark, sink, states.schema).drop("epoch")
    newest = rows.groupBy("id").agg(F.max(F.struct("last_crawled_at", "due")).alias("s")).select("id", "s.*")
    companies = T.companies(spark, sf).filter("is_active").select(F.col("id").cast("long").alias("id"))
    kind = T.read_table(spark, sf, "orders").schema["o_orderdate"].dataType
    return companies.join(newest, "id", "left").filter(F.coalesce("due", F.lit(True))).select(
        "id", F.col("last_crawled_at").cast(kind).alias("last_crawled_at"))


@query("stream_dedup", ids=("K5", "E9"), sql="SELECT DISTINCT sha256(text) AS text_hash FROM documents")
def stream_dedup(spark, sf):
    d = T.read_table(spark, sf, "documents").select("doc_id", "text")
    src = K.staged_stream(d, "doc_id", N_BATCHES, "documents").select(S.url_hash("text").alias("text_hash"))
    sink = K.run_available_now(src, "dedup", writer=K.dedupe_writer("text_hash"))
    return stored.read_new(spark, sink, src.schema)


@query("stream_parse", ids=("K7", "I5"), sql="WITH " + _HEUR_SQL + """
SELECT page_id, CASE WHEN reject_reason IS NULL THEN 'heuristics' ELSE 'reject' END AS parse_strategy,
       CASE WHEN reject_reason IS NULL THEN title END AS title, CASE WHEN reject_reason IS NULL THEN company END AS company,
       reject_reason FROM heur""")
def stream_parse(spark, sf):
    """Pages stream -> extraction -> parse cascade (stateless)."""
    p = T.read_table(spark, sf, "pages")
    src = K.staged_stream(p, "page_id", N_BATCHES, "pages")
    cols = ["page_id", "parse_strategy", "title", "company", "reject_reason"]

    def parse_batch(batch):
        # stateless per page: each micro-batch is parsed as a batch
        return H.parse_cascade(H.extract_pages(batch)).select(*cols)

    sink = K.run_available_now(src, "parse", transform=parse_batch)
    schema = H.parse_cascade(H.extract_pages(p.limit(0))).select(*cols).schema
    return K.read_epochs(spark, sink, schema).drop("epoch")
