"""Structured Streaming operators (K1-K7).

Sources are file streams (``readStream.parquet``) read with
``Trigger.AvailableNow`` — the batch-like incremental run the source's
six-hourly schedule corresponds to. Sinks write each micro-batch into its
own ``epoch=N`` folder (overwritten if the batch is retried), so a lost
executor or a restarted query never duplicates output; readers merge the
epochs. Checkpoints and sinks live under the shared folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from hirelake.operators import stored
from hirelake.operators.dedupe import latest_version
from hirelake.operators.health import FAIL_LIMIT
from hirelake.session import BASE_CONF, scratch_path, settings
from hirelake.sources.tables import input_bytes, parts


# ---------------------------------------------------------------- sources and sinks

#: MB of the table's files to a staged file, so that a task's share does not grow with the table
STAGED_MB = 16


def stage(df: DataFrame, time_col: str, n_files: int, name: str) -> str:
    """Write a table to a fresh landing folder, one ordinary parallel write in
    ``n_files`` ranges of ``time_col`` or more: a large table gets more of
    them. This stages the given tables for the registered stream queries; in
    production the producer writes the landing folder. Files may be picked up in
    any order, so the operators do not rely on it."""
    path = scratch_path(df.sparkSession, f"landing-{name}")
    df.repartitionByRange(parts(input_bytes(df), STAGED_MB, n_files), time_col).write.parquet(path)
    return path


def staged_stream(df: DataFrame, time_col: str, n_batches: int, name: str) -> DataFrame:
    """A table staged and read as a stream of ``n_batches`` micro-batches,
    however many files it takes."""
    path = stage(df, time_col, n_batches, name)
    files = len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    return file_stream(df.sparkSession, path, df.schema, max(1, math.ceil(files / n_batches)))


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = 1) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def _epoch_writer(path: str, transform=None):
    def write(batch: DataFrame, epoch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")
    return write


def run_available_now(stream: DataFrame, name: str, mode: str = "append", transform=None, sink: str | None = None,
                      checkpoint: str | None = None, writer=None, conf: dict[str, str] | None = None) -> str:
    """Run a streaming plan to completion over what is available, however long
    that takes; a failure is raised. Returns the sink folder (``epoch=N`` sub-folders). Passing the same ``sink`` and
    ``checkpoint`` again resumes: only new input is processed. ``writer``, if given, makes the micro-batch writer of
    a sink folder (``upsert_writer``, ``dedupe_writer``); a batch that is repeated after a failure keeps its epoch.
    ``conf`` are session settings that this stream needs (``DUE_CONF``); a stream keeps those it is started with."""
    spark = stream.sparkSession
    sink = sink or scratch_path(spark, f"sink-{name}")
    ckpt = checkpoint or scratch_path(spark, f"ckpt-{name}")
    write = writer(sink) if writer else _epoch_writer(sink, transform)
    with settings(spark, conf or {}):
        q = (stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(write)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return sink


def read_epochs(spark: SparkSession, sink: str, schema) -> DataFrame:
    """All rows of an epoch-folder sink with their ``epoch`` column. A folder
    that no batch has written yet is empty; any other trouble is an error."""
    from pyspark.sql.types import LongType, StructField, StructType
    full = StructType(schema.fields + [StructField("epoch", LongType())])
    place = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(sink)


def latest_by_epoch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge of update-mode epochs: the newest epoch's row per key."""
    return latest_version(df, keys, ["epoch"]).drop("epoch")


# ---------------------------------------------------------------- K1, K5, K7: stateless / dedupe

def stream_active(src: DataFrame, as_of, min_score: int = 70, days: int = 90) -> DataFrame:
    """K1: the insert-time active filter as a streaming append plan. ``as_of``
    is the ingest clock of the run (never read from the wall clock here)."""
    from hirelake.functions.scalars import days_before
    return src.filter((F.col("real_score") >= min_score) & (F.col("posted_at") >= days_before(as_of, days)))


def dedupe_writer(key: str, prefix: int = 1, merge_every: int = 50):
    """K5, exact and without operator state: a micro-batch's distinct keys are
    anti-joined with the keys stored so far and added with the batch's epoch
    (``stored.append_new``). What Spark keeps between batches does not grow
    with the history, and a repeated batch adds nothing. Each ``merge_every``
    epochs the stored ones become one folder."""
    def writer(path: str):
        def write(batch: DataFrame, epoch: int) -> None:
            stored.append_new(batch, path, epoch, key, prefix)
            if (epoch + 1) % merge_every == 0:
                stored.merge_epochs(batch.sparkSession, path, batch.schema)
        return write
    return writer


def stream_dedup(src: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """K5 in operator state: drop repeated keys across micro-batches. With an
    event-time column the state is bounded by a watermark
    (``dropDuplicatesWithinWatermark``) and keys that return later count as
    new; without one every key seen is kept in state. ``dedupe_writer`` is exact
    with neither."""
    if event_time:
        return src.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return src.dropDuplicates([key])


# ---------------------------------------------------------------- K2: incremental roll-up

def stream_rollup(src: DataFrame, as_of, min_score: int = 70, days: int = 90, delay: str | None = None) -> DataFrame:
    """K2: per day and platform running counters (update mode). With ``delay``
    a watermark on ``posted_at`` lets the state of old days go; later rows of
    those days are then dropped, so the caller states how late rows may be."""
    from hirelake.operators.listing import active_predicate
    if delay:
        src = src.withColumn("posted_at", F.col("posted_at").cast("timestamp")).withWatermark("posted_at", delay)
    return (src.groupBy(F.to_date("posted_at").alias("stat_date"), "source_platform")
            .agg(F.count(F.lit(1)).alias("total_jobs"),
                 F.count_if(active_predicate(as_of, min_score, days)).alias("active_jobs"),
                 F.sum(F.col("real_score").cast("long")).alias("sum_real_score")))


# ---------------------------------------------------------------- K3: upsert stream

def upsert_writer(keys: list[str], order: list[str], buckets: int = stored.BUCKETS, keep: int = 2):
    """Each micro-batch is brought into a stored table under its epoch
    (``stored.upsert``): only the buckets that it touches are rewritten, a
    repeated batch changes nothing, and versions that newer epochs replaced are
    removed but for the ``keep`` newest epochs'."""
    def writer(path: str):
        def write(batch: DataFrame, epoch: int) -> None:
            stored.upsert(batch, path, epoch, keys, order, buckets)
            stored.vacuum(batch.sparkSession, path, keep)
        return write
    return writer


def stream_latest_batch(keys: list[str], order: list[str]):
    """K3 micro-batch transform: latest row per key inside the batch; the
    reader keeps the latest across batches with the same order."""
    def transform(batch: DataFrame) -> DataFrame:
        return latest_version(batch, keys, order)
    return transform


# ---------------------------------------------------------------- K4: stateful health

HEALTH_STATE = "success_count long, last array<long>, fails array<array<long>>"


def _health_update(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a batch into the state: the successes so far, the place of the
    last one in the order, and the places of the failures after it. Batches
    may come in any order."""
    count, last, fails = state.get if state.exists else (0, [], [])
    last, fails = tuple(last or ()), [tuple(f) for f in fails or ()]
    for p in pdfs:
        places = list(zip(*(p[c].tolist() for c in p.columns if c.startswith("__o"))))
        won = p["is_success"].to_numpy(bool)
        count += int(won.sum())
        last = max([last, *(x for x, s in zip(places, won) if s)])
        fails += [x for x, s in zip(places, won) if not s]
    fails = [f for f in fails if f > last]
    state.update((count, list(last), [list(f) for f in fails]))
    yield pd.DataFrame({"key": [key[0]], "success_count": [count], "fail_count": [len(fails)],
                        "is_healthy": [len(fails) < FAIL_LIMIT]})


def stream_health(src: DataFrame, key: str, is_success, is_failure,
                  order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """K4: per-key health state machine kept in the state store; each batch
    emits the new state of the keys it touched (update mode). ``order`` is a
    total order of timestamps or whole numbers; events may arrive out of it. A
    key's state holds its run of failures since its last success. The key
    keeps its name and type."""
    def place(c):
        kind = src.schema[c].dataType.typeName()
        return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(c).cast("long")

    kind = src.schema[key].dataType.simpleString()
    ev = src.select(F.col(key).alias("key"), *[place(c).alias(f"__o{i}") for i, c in enumerate(order)],
                    is_success.alias("is_success"), is_failure.alias("is_failure")) \
        .filter(F.col("is_success") | F.col("is_failure"))
    out = ev.groupBy("key").applyInPandasWithState(
        _health_update, f"key {kind}, success_count long, fail_count long, is_healthy boolean", HEALTH_STATE, "update",
        GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("key", key)


# ---------------------------------------------------------------- K6: due selection with timers

DUE_SCHEMA = "id long, at_ms long, due boolean"
#: timers take a state store with column families, which Spark's default provider has not
DUE_CONF = {k: v for k, v in BASE_CONF.items() if k == "spark.sql.streaming.stateStore.providerClass"}


class _DueTimer(StatefulProcessor):
    """Per company its latest crawl, and a timer for when the next is due."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.crawl = handle.getValueState("crawl", "last long")

    def _row(self, key, last: int, due: bool) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "at_ms": [last], "due": [due]})

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(p["at_ms"].max()) for p in rows)
        last = self.crawl.get()[0] if self.crawl.exists() else None
        if last is not None and newest <= last:
            return
        if last is not None:
            self.handle.deleteTimer(last + self.wait_ms)
        self.crawl.update((newest,))
        self.handle.registerTimer(newest + self.wait_ms)
        yield self._row(key, newest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._row(key, self.crawl.get()[0], True)

    def close(self) -> None:
        pass


def _latest_of_batch(batches):
    """The latest crawl of each company in an Arrow batch: a company with most
    of the crawls goes into the shuffle as one row a batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("id").aggregate([("crawled_at", "max")])
        t = t.rename_columns([c.replace("_max", "") for c in t.column_names]).select(["id", "crawled_at"])
        yield from t.cast(b.schema).combine_chunks().to_batches()


def stream_due(crawls: DataFrame, days: int = 7, delay: str = "0 seconds") -> DataFrame:
    """K6: ``(id, last_crawled_at, due)`` whenever a company's state changes.
    ``crawls`` is ``(id, crawled_at)``; rows without an id are ticks of the clock.
    A company becomes due once the event clock (the watermark) passes its latest
    crawl by ``days``: a timer says so, without a scan of the companies. A later
    crawl moves the timer and takes the company off the due ones. The state is
    one row a company. The newest row per id (by crawl, then due) holds. To be
    started under ``DUE_CONF``."""
    wait_ms = days * 86_400_000 + 1  # a timer fires at its time; due is later than that
    src = crawls.select(F.col("id").cast("long").alias("id"), F.col("crawled_at").cast("timestamp").alias("crawled_at"))
    src = src.mapInArrow(_latest_of_batch, src.schema).withWatermark("crawled_at", delay)
    # the ticks end behind the watermark: a condition on the id alone would be pushed below it
    src = src.filter(F.when(F.col("id").isNotNull(), F.col("crawled_at").isNotNull()).otherwise(False))
    src = src.withColumn("at_ms", F.unix_millis("crawled_at"))
    out = src.groupBy("id").transformWithStateInPandas(_DueTimer(wait_ms), DUE_SCHEMA, "Update", "EventTime")
    return out.select("id", F.timestamp_millis("at_ms").alias("last_crawled_at"), "due")
