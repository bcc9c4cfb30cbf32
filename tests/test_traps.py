"""More golden rows for the traps."""

import datetime as dt

from pyspark.sql import functions as F

from hirelake.operators import aggregates as A
from hirelake.operators import export as E
from hirelake.operators import listing as L
from hirelake.operators import sequence as Q
from hirelake.streaming import streams as K


def test_query_time_vs_insert_time_active(spark):
    # a posting that was active when inserted stops being active at query time
    jobs = spark.createDataFrame([(1, 80, dt.datetime(2024, 1, 1))], "id long, real_score int, posted_at timestamp")
    at_insert = L.active_filter(jobs, "2024-01-02 00:00:00").count()
    later = L.active_filter(jobs, "2024-06-01 00:00:00").count()
    assert (at_insert, later) == (1, 0)


def test_stalest_nulls_first(spark):
    comp = spark.createDataFrame([(1, True, dt.datetime(2020, 1, 1)), (2, True, None), (3, False, None),
                                  (4, True, dt.datetime(2019, 1, 1))], "id long, is_active boolean, last_crawled_at timestamp")
    ids = [r["id"] for r in L.stalest(comp, "2024-01-01 00:00:00", days=7, n=50).collect()]
    assert ids == [2, 4, 1]


def test_touch_reaches_every_due_company(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [(i, True, None if i % 3 else dt.datetime(2020, 1, 1)) for i in range(120)] + [(120, True, dt.datetime(2023, 12, 31))]
    comp = spark.createDataFrame(rows, "id long, is_active boolean, last_crawled_at timestamp")
    due = L.stalest(comp, "2024-01-01 00:00:00")
    got = {r["id"]: r["last_crawled_at"] for r in L.touch_crawled(comp, due, "2024-01-01 00:00:00").collect()}
    assert due.count() == 120 and got == {**{i: now for i in range(120)}, 120: dt.datetime(2023, 12, 31)}


def test_rollup_merge_keeps_exact_average(spark):
    s = "stat_date date, source_platform string, total_jobs long, active_jobs long, sum_real_score long, jobs_with_manager long"
    a = spark.createDataFrame([(dt.date(2024, 1, 1), "p", 2, 1, 100, 1)], s)
    b = spark.createDataFrame([(dt.date(2024, 1, 1), "p", 1, 0, 20, 0)], s)
    r = A.merge_daily_stats(a, b).first()
    assert (r["total_jobs"], r["sum_real_score"], r["avg_real_score"]) == (3, 120, 40.0)


def test_batches_per_group(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b") for i in range(25)], "g string, i int")
    out = Q.batches(df, 10, [F.col("i")], group=["g"]).collect()
    got = {(r["g"], r["i"]): r["batch_id"] for r in out}
    assert got[("a", 0)] == 0 and got[("a", 9)] == 0 and got[("a", 10)] == 1 and got[("b", 24)] == 2


def test_import_tally_malformed_is_error(spark):
    lines = spark.createDataFrame([('{"success": true}',), ('{"success": false, "error": "x"}',), ('"k": 1}',)],
                                  "line string")
    r = E.import_tally(lines).first()
    assert (r["n_success"], r["n_error"]) == (1, 2)


def test_search_document_omits_nulls(spark):
    jobs = spark.createDataFrame([(1, "T", None, 1, dt.datetime(2024, 1, 1), [])],
                                 "id long, title string, currency string, remote int, posted_at timestamp, tags array<string>")
    doc = E.search_documents(jobs).first()["doc"]
    assert doc == '{"id":"1","title":"T","remote":true,"posted_at":1704067200}'


def test_watermark_dedupe_is_streaming(spark):
    src = spark.readStream.format("rate").option("rowsPerSecond", 1).load().withColumn("k", F.col("value") % 2)
    out = K.stream_dedup(src, "k", event_time="timestamp", delay="1 minute")
    assert out.isStreaming


def test_rfc3339_with_fallback(spark):
    from hirelake.functions import scalars as S
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("",), (None,), ("not a date",)], "s string")
    # text form: year 1 does not survive conversion to a Python datetime
    got = [r[0] for r in df.select(S.ts_text(S.parse_rfc3339("s", "2024-05-05 00:00:00"))).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-05-05 00:00:00", "2024-05-05 00:00:00", "0001-01-01 00:00:00"]
