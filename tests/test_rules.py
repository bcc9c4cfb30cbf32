"""Rules that the small fixtures once did not reach: URL joins, row numbers
with payload columns, both branches of each flag, hot keys, arrival order."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hirelake.functions import scalars as S
from hirelake.operators import dedupe as D
from hirelake.operators import health as HL
from hirelake.operators import html as H
from hirelake.operators import search as R
from hirelake.operators import sequence as Q
from hirelake.operators.store import raw_page_rows
from hirelake.plans.registry import QUERIES, load_all
from hirelake.sources import tables as T
from hirelake.streaming import streams as K

load_all()
SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"

BASES = ["https://h.example.com", "https://h.example.com/", "https://h.example.com/a/b/c", "http://h.example.com/a/b/",
         "https://u@h.example.com:8080/x/y?q=1&r=/../z#frag", "HTTPS://H.example.com/a/../b"]
HREFS = ["", " ", "x", "/x", "//o.example.org/p/../q", "../x", "../../x", "../../../../../../x", "./x", "/./././x", "a/./b/../c", "..",
         ".", "/a/b/..", "/a/b/.", "?q=2", "#top", "/jobs/1?next=/x/../y", "/jobs/1#/x/../y", "  /x", "\n/jo\tbs/\r\n2", "x y",
         "mailto:a@b.c", "javascript:void(0)", "tel:+1", "https://o.example.org/a/../b?c#d", "http:x", "https:x/y", "/a//b///c",
         "a//b", "x/", "x?", "x#", "?", "/é/ü?ö#ß", "x;p=1", "/x?a=b?c", "x#a#b", "...", "/..x/../y", "&amp;x=1"]


def test_url_join_equals_the_standard_library(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "b string, h string").select("b", "h", S.resolve_url("b", "h").alias("u"))
    for r in df.collect():
        assert r["u"] == urljoin(r["b"], r["h"]), (r["b"], r["h"])


@pytest.mark.parametrize("partitions", [8, 64])
def test_row_numbers_with_payload_columns(spark, partitions):
    o = T.read_table(spark, LARGE, "orders")
    got = Q.global_index(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], partitions=partitions)
    assert got.columns == [*o.columns, "idx"]
    w = Window.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey"))
    want = o.select(F.col("o_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("want"))
    both = got.join(want, F.col("o_orderkey") == F.col("k"))
    assert both.count() == o.count() and both.filter("idx <> want").count() == 0


BRANCHES = {  # query: conditions that must each hold on some row
    "seen_hash": ["seen", "NOT seen"], "harvest_hosts": ["is_job_related", "NOT is_job_related"],
    "ct_hosts": ["is_job_related", "NOT is_job_related"], "host_pages": ["confidence = 0.5 AND priority = 2", "confidence = 0.8 AND priority = 1"],
    "tag_results": ["is_ats AND confidence = 0.95", "is_ats AND confidence = 0.6", "NOT is_ats"],
    "ats_url": ["confidence = 0.95", "confidence = 0.75", "confidence = 0.6", "NOT is_ats"],
    "page_result": ["pages_fetched > 0", "jobs_stored > 0", "jobs_stored < pages_fetched", "links_followed > pages_fetched",
                    "NOT success", "success"],
    "ingest_postings": ["company LIKE 'Crawl of %'", "company NOT LIKE 'Crawl of %'", "id LIKE '%-1-%'"],
    "career_score": ["discovered_via = 'path'", "discovered_via = 'subdomain'"],
    "seed_counts": ["added > 0 AND skipped > 0"], "heuristics": ["reject_reason IS NULL", "reject_reason = 'short_description'"],
}


@pytest.mark.parametrize("name", sorted(BRANCHES))
def test_each_branch_occurs(spark, name):
    df = QUERIES[name](spark, SMALL)
    row = df.agg(*[F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(BRANCHES[name])]).first()
    assert all(row), dict(zip(BRANCHES[name], row))


def test_new_rows_and_probes_leave_some_out(spark):
    docs = T.read_table(spark, SMALL, "documents")
    assert 0 < QUERIES["new_only"](spark, SMALL).count() < docs.filter("source <> 'src0'").count()
    assert 0 < QUERIES["seed_absent"](spark, SMALL).count() < T.read_table(spark, SMALL, "customer").count()
    assert QUERIES["career_score"](spark, SMALL).count() < docs.count()


def test_result_rows_are_not_cut(spark):
    assert QUERIES["result_rows"](spark, SMALL).filter("rank > 100").count() > 0


def _largest_share(df):
    """Rows of the fullest partition over all rows, before any result is gathered."""
    n = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_a_hot_key_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
                                        F.col("id").alias("t"))
        out = D.seen_window(df, "k", "t")
        assert _largest_share(out) < 0.3  # a plain join puts the third of the hot key in one task
        hot = out.filter("k = 'hot'").select("first_seen", "last_seen").distinct().collect()
        assert [tuple(r) for r in hot] == [(0, 29997)] and out.filter("first_seen > t OR last_seen < t").count() == 0
        ev = df.withColumn("ok", F.col("t") % 7 == 0)
        plan = HL.health_fold(ev, "k", ["t"], F.col("ok"), ~F.col("ok"))._jdf.queryExecution().executedPlan().toString()
        deals = [x.split(")")[0] for x in plan.split("Exchange hashpartitioning(")[1:]]
        assert len(deals) == 2 and "__b" in deals[1] and plan.count("Range (") == 1  # the rows by key and bucket, in one scan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_health_of_text_keys_in_any_arrival_order(spark):
    rows = [("p1", t, t % 10 == 3) for t in range(40)] + [("p2", t, False) for t in range(5)] + [("p3", 1, True), ("p3", 2, False)]
    want = {}
    for k, t, ok in rows:
        s, f = want.get(k, (0, 0))
        want[k] = (s + 1, 0) if ok else (s, f + 1)
    df = spark.createDataFrame(rows, "proxy string, t long, ok boolean")
    batch = {r["proxy"]: (r["success_count"], r["fail_count"]) for r in HL.health_fold(df, "proxy", ["t"], F.col("ok"), ~F.col("ok")).collect()}
    assert batch == want
    path = K.scratch_path(spark, "events")
    for part in ("t % 3 = 2", "t % 3 = 0", "t % 3 = 1"):  # later events come first
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    st = K.stream_health(K.file_stream(spark, path, df.schema), "proxy", F.col("ok"), ~F.col("ok"), order=("t",))
    assert st.schema["proxy"].dataType.simpleString() == "string"
    sink = K.run_available_now(st, "health", mode="update")
    got = K.latest_by_epoch(K.read_epochs(spark, sink, st.schema), ["proxy"]).collect()
    assert {r["proxy"]: (r["success_count"], r["fail_count"]) for r in got} == want
    assert {r["proxy"]: r["is_healthy"] for r in got} == {"p1": False, "p2": False, "p3": True}


def test_an_unreadable_sink_is_an_error(spark, tmp_path):
    schema = spark.range(1).schema
    assert K.read_epochs(spark, f"{tmp_path}/none", schema).count() == 0
    (tmp_path / "bad" / "epoch=0").mkdir(parents=True)
    (tmp_path / "bad" / "epoch=0" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        K.read_epochs(spark, f"{tmp_path}/bad", schema).collect()


def test_raw_page_rows_can_be_parsed(spark):
    raw = raw_page_rows(T.read_table(spark, SMALL, "pages"), "2024-01-31 00:00:00")
    got = H.extract_pages(raw, id_col="id")
    assert got.schema["page_id"].dataType.simpleString() == "string"
    assert got.select("page_id").distinct().count() == raw.select("id").distinct().count()
    assert got.filter("parse_error IS NOT NULL").count() == 0


def test_fractions_of_any_length(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05.123456789Z",), ("2024-01-02T03:04:05.5+01:00",)], "s string")
    got = [r[0] for r in df.select(S.ts_text(S.parse_rfc3339("s", "2024-05-05 00:00:00"))).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 02:04:05"]


def test_query_words_are_cut_like_indexed_words(spark):
    df = spark.createDataFrame([(1, "snake_case _foo Bär42")], "doc_id long, text string")
    words = [r["w"] for r in df.select(F.explode(R.tokens("text")).alias("w")).collect()]
    assert R.query_tokens("snake_case _foo Bär42") == words
    for q in ("snake_case", "_foo"):
        assert R.search_hits(R.build_index(df, {"text": "text"}), q).count() == 1
