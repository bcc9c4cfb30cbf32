"""Streaming restart and search-index layout."""

import datetime
import os

from pyspark.sql import functions as F

from hirelake.operators import search as R
from hirelake.operators import stored
from hirelake.session import scratch_path
from hirelake.sources import tables as T
from hirelake.streaming import streams as K

SF = "/root/testdata/sf0.001"


def _epochs(path):
    local = path[len("file:"):] if path.startswith("file:") else path
    return sorted(d for d in os.listdir(local) if d.startswith("epoch="))


def test_restart_processes_only_new_files(spark):
    e = T.read_table(spark, SF, "events")
    landing = K.stage(e, "ts", 2, "restart")
    src = K.file_stream(spark, landing, e.schema)
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    sink, ckpt = scratch_path(spark, "sink-r"), scratch_path(spark, "ckpt-r")
    K.run_available_now(src, "r", transform=K.stream_latest_batch(keys, order), sink=sink, checkpoint=ckpt)
    first = _epochs(sink)
    # same checkpoint, no new input: nothing is reprocessed
    K.run_available_now(K.file_stream(spark, landing, e.schema), "r", transform=K.stream_latest_batch(keys, order),
                        sink=sink, checkpoint=ckpt)
    assert _epochs(sink) == first
    # new file arrives: exactly one more batch, and the merged result equals the batch query
    e.limit(5).write.mode("append").parquet(landing)
    K.run_available_now(K.file_stream(spark, landing, e.schema), "r", transform=K.stream_latest_batch(keys, order),
                        sink=sink, checkpoint=ckpt)
    assert len(_epochs(sink)) == len(first) + 1
    from hirelake.operators.dedupe import latest_version
    merged = latest_version(K.read_epochs(spark, sink, e.schema).drop("epoch"), keys, order)
    batch = latest_version(e, keys, order)
    assert sorted(merged.select(*e.columns).collect()) == sorted(batch.select(*e.columns).collect())


def test_upsert_stream_restarts_and_repeats(spark):
    e = T.read_table(spark, SF, "events")
    landing = K.stage(e, "ts", 2, "stored")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    sink, ckpt = scratch_path(spark, "sink-u"), scratch_path(spark, "ckpt-u")

    def run():
        K.run_available_now(K.file_stream(spark, landing, e.schema), "u", sink=sink, checkpoint=ckpt,
                            writer=K.upsert_writer(keys, order, buckets=8))

    run()
    first = stored.closed(spark, sink, "epoch")
    run()  # nothing new: no epoch
    assert stored.closed(spark, sink, "epoch") == first
    e.limit(5).write.mode("append").parquet(landing)
    run()
    assert len(stored.closed(spark, sink, "epoch")) == len(first) + 1
    # the last batch comes again under its epoch, as after a crash before the checkpoint's commit
    last = max(map(int, stored.closed(spark, sink, "epoch")))
    assert stored.upsert(e.limit(5).withColumn("value", F.lit(-1.0)), sink, last, keys, order, 8) == []
    from hirelake.operators.dedupe import latest_version
    got = stored.read_upserted(spark, sink, e.schema)
    assert sorted(got.collect()) == sorted(latest_version(e, keys, order).select(*e.columns).collect())


def test_dedupe_stream_is_exact_over_restarts(spark):
    kind = "k string, v long"
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("landing-d", "sink-d", "ckpt-d"))
    want = set()
    for i, keys in enumerate([["a", "b", "a"], ["b", "c"], ["a", "d", "d"]]):
        df = spark.createDataFrame([(k, i) for k in keys], kind)
        df.coalesce(1).write.mode("append").parquet(landing)
        K.run_available_now(K.file_stream(spark, landing, df.schema), "d", sink=sink, checkpoint=ckpt, writer=K.dedupe_writer("k"))
        want |= {(k, i) for k in keys if k not in {w[0] for w in want}}
        assert {tuple(r) for r in stored.read_new(spark, sink, df.schema).collect()} == want


def test_a_late_crawl_moves_the_timer(spark):
    kind = "id long, crawled_at timestamp"
    landing, sink, ckpt = (scratch_path(spark, n) for n in ("landing-t", "sink-t", "ckpt-t"))

    def day(n):
        return datetime.datetime(2024, 1, n)

    def feed(*rows):
        df = spark.createDataFrame(list(rows), kind)
        df.coalesce(1).write.mode("append").parquet(landing)
        states = K.stream_due(K.file_stream(spark, landing, df.schema), days=7)
        K.run_available_now(states, "t", mode="update", sink=sink, checkpoint=ckpt)
        rows = K.read_epochs(spark, sink, states.schema)
        newest = rows.groupBy("id").agg(F.max(F.struct("last_crawled_at", "due")).alias("s")).select("id", "s.*").collect()
        return {r.id: (r.last_crawled_at.day, r.due) for r in newest}

    assert feed((1, day(1)), (1, day(2)), (2, day(2)), (None, day(8))) == {1: (2, False), 2: (2, False)}
    # company 1 is crawled again before it is due; the clock then passes company 2's time
    assert feed((1, day(9)), (None, day(9))) == {1: (9, False), 2: (2, False)}
    assert feed((None, day(10))) == {1: (9, False), 2: (2, True)}
    # a crawl after the timer fired takes it off, until seven days have passed again
    assert feed((2, day(11)), (None, day(11))) == {1: (9, False), 2: (11, False)}
    assert feed((None, day(17))) == {1: (9, True), 2: (11, False)}
    assert feed((None, day(19))) == {1: (9, True), 2: (11, True)}


def test_index_written_by_prefix_is_pruned(spark):
    d = T.read_table(spark, SF, "documents")
    idx = R.build_index(d, {"description": "text"})
    path = scratch_path(spark, "index")
    R.write_index(idx, path)
    back = spark.read.parquet(path)
    hits = R.search_hits(back, "the river")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan and "IN (r,t)" in plan
    assert hits.count() > 0


def test_due_timers_in_a_session_with_the_default_state_store(spark):
    from hirelake.plans import registry
    registry.load_all()
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(key, default)
    try:
        rows = registry.QUERIES["stream_due"](spark, SF).collect()
        assert spark.conf.get(key) == default  # the session's own setting stays
    finally:
        spark.conf.set(key, before)
    due = {r.c_custkey for r in T.read_table(spark, SF, "customer").collect()}
    assert rows and len({r.id for r in rows}) == len(rows) and {r.id for r in rows} <= due


def test_a_large_table_is_staged_in_more_files_but_not_more_batches(spark, tmp_path, monkeypatch):
    """A task of the staging holds a share that does not grow with the table."""
    rows = spark.range(4000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = T.input_bytes(df)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert T.parts(size, 1, 2) == 2 and T.parts(6 << 30, 16, 4) == 384
    monkeypatch.setattr(K, "parts", lambda n, mb, least: T.parts(n * (10 << 20) // size, 1, least))  # as if it had 10 MB
    landing = K.stage(df, "k", 4, "wide")
    per_file = spark.read.parquet(landing).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 10 and max(r["count"] for r in per_file) < 1000  # four files would hold 1000 each
    sink = K.run_available_now(K.staged_stream(df, "k", 4, "wide"), "wide")
    got = K.read_epochs(spark, sink, df.schema)
    assert sorted(got.drop("epoch").collect()) == sorted(df.collect()) and len(_epochs(sink)) == 4
