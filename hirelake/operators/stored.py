"""Stored tables that bear repeated and interrupted writes.

A write goes to a folder of its own, named after its batch or epoch, and is
closed by a marker file. Readers list the folders with a marker and read those
only; a write that was killed has none, and its repetition overwrites it. A
batch that is done already is left as it is, so repeating it changes nothing.
One job at a time writes a table.

* ``append_once``: each batch adds its rows, once.
* ``upsert``: rows live in buckets by the hash of their key. A batch rewrites
  the buckets it touches, into its epoch's folder; the newest closed epoch of
  a bucket is its content. ``vacuum`` removes the ones before.
* ``append_new``: rows whose key no earlier epoch holds. The table is the state
  of an exact dedupe; a batch's keys are looked up in the key column alone.
  ``merge_epochs`` brings many small epochs into one folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators.dedupe import latest_version

MARKER = "_CLOSED"
BUCKETS = 64


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str, key: str) -> dict[str, str]:
    """The folders ``key=value`` in ``path``, by value."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return {n.partition("=")[2]: f"{path}/{n}" for n in names if n.startswith(f"{key}=")}


def is_closed(spark: SparkSession, folder: str) -> bool:
    fs, place = _place(spark, f"{folder}/{MARKER}")
    return fs.exists(place)


def close(spark: SparkSession, folder: str) -> None:
    fs, place = _place(spark, f"{folder}/{MARKER}")
    fs.create(place, True).close()


def _remove(spark: SparkSession, folder: str) -> None:
    fs, place = _place(spark, folder)
    fs.delete(place, True)


def closed(spark: SparkSession, path: str, key: str = "batch") -> dict[str, str]:
    """The folders of finished writes."""
    return {v: f for v, f in _folders(spark, path, key).items() if is_closed(spark, f)}


def _read(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


# ---------------------------------------------------------------- appends

def append_once(df: DataFrame, path: str, batch_id: str, partition_by: tuple[str, ...] = ()) -> bool:
    """Add ``df`` as batch ``batch_id``; False if that batch is in the table
    already. A job that is run again, whether it died in the middle or was
    only thought to, leaves its rows in the table once."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError(f"batch id {batch_id!r} makes no folder name")
    spark, folder = df.sparkSession, f"{path}/batch={batch_id}"
    if is_closed(spark, folder):
        return False
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    close(spark, folder)
    return True


def read_appended(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished batches, with their ``batch``. ``schema`` holds
    the partition columns, if any, too."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
    folders = list(closed(spark, path).values())
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*folders)


# ---------------------------------------------------------------- upserts

def _buckets(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """Each bucket's newest closed epoch and folder."""
    newest: dict[str, tuple[int, str]] = {}
    for epoch, folder in closed(spark, path, "epoch").items():
        for b, place in _folders(spark, folder, "bucket").items():
            newest[b] = max(newest.get(b, (-1, "")), (int(epoch), place))
    return newest


def upsert(batch: DataFrame, path: str, epoch: int, keys: list[str], order: list[str], buckets: int = BUCKETS) -> list[int]:
    """Bring ``batch`` into the table: per key the row with the greatest
    ``order`` of what is there and what comes. Returns the buckets rewritten,
    none for an epoch that is closed already. The batch is reduced to one row a
    key first (map-side), so a hot key costs a bucket one row."""
    spark, folder = batch.sparkSession, f"{path}/epoch={epoch}"
    if is_closed(spark, folder):
        return []
    made = _folders(spark, path, "buckets")
    if made and str(buckets) not in made:
        raise ValueError(f"the table has {', '.join(made)} buckets, not {buckets}")
    names = batch.columns
    if clash := {"bucket", "epoch"}.intersection(names):
        raise ValueError(f"columns {sorted(clash)} are names of the table's folders")
    staged = f"{path}/_staged/epoch={epoch}"
    new = latest_version(batch, keys, order).select(*names).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    touched = _folders(spark, staged, "bucket")
    there = _buckets(spark, path)
    if touched:
        full = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = spark.read.schema(full).parquet(staged)
        old = [place for b, (_, place) in there.items() if b in touched]
        if old:
            rows = rows.unionByName(spark.read.schema(full).option("basePath", path).parquet(*old).select(*full.names))
        # one shuffle: by bucket, which is a part of the grouping key and the layout of the files
        merged = latest_version(rows.repartition(len(touched), "bucket"), ["bucket", *keys], order)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    close(spark, f"{path}/buckets={buckets}")
    close(spark, folder)
    _remove(spark, staged)
    return sorted(map(int, touched))


def read_upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table's rows: every bucket as its newest closed epoch left it."""
    return _read(spark, path, [place for _, place in _buckets(spark, path).values()], schema)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove folders of buckets that a newer closed epoch replaced, but for the
    ``keep`` newest epochs' (a reader may have listed them). Returns how many."""
    epochs = sorted(closed(spark, path, "epoch").items(), key=lambda x: int(x[0]))
    newest, gone = _buckets(spark, path), 0
    for epoch, folder in epochs[:-keep] if keep else epochs:
        for b, place in _folders(spark, folder, "bucket").items():
            if newest[b][0] > int(epoch):
                _remove(spark, place)
                gone += 1
    return gone


# ---------------------------------------------------------------- exact dedupe

def _epochs(spark: SparkSession, path: str) -> tuple[dict[int, str], dict[int, str]]:
    """The folders of closed epochs, and of merges up to an epoch. A merge has
    a negative number, so that all folders are partitions of one column."""
    found = {int(v): f for v, f in closed(spark, path, "epoch").items()}
    return {e: f for e, f in found.items() if e >= 0}, {-e - 1: f for e, f in found.items() if e < 0}


def _live(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The last epoch merged (-1: none), and the folders that hold the table:
    the newest merge, and the closed epochs after it."""
    epochs, merges = _epochs(spark, path)
    upto = max(merges, default=-1)
    return upto, ([merges[upto]] if merges else []) + [f for e, f in epochs.items() if e > upto]


def append_new(batch: DataFrame, path: str, epoch: int, key: str, prefix: int = 1) -> bool:
    """Add one row of each ``key`` that no earlier epoch holds; False for an
    epoch that is in the table. The earlier keys are read, one column, from the
    folders of the prefixes in question; a batch that the planner measures as
    small is broadcast to them, so that the history is scanned but not shuffled."""
    spark, folder = batch.sparkSession, f"{path}/epoch={epoch}"
    upto, earlier = _live(spark, path)
    if epoch <= upto or is_closed(spark, folder):
        return False
    staged = f"{path}/_staged/epoch={epoch}"
    part = F.coalesce(F.substring(F.col(key).cast("string"), 1, prefix), F.lit("null"))
    batch.dropDuplicates([key]).withColumn("prefix", part).write.mode("overwrite").parquet(staged)
    new = spark.read.parquet(staged)
    if earlier:
        seen = spark.read.schema(T.StructType([batch.schema[key], T.StructField("prefix", T.StringType())])).option(
            "basePath", path).parquet(*earlier).select(F.col(key).alias("__key"), F.col("prefix").alias("__prefix"))
        keys = new.select(F.col(key).alias("__new"), F.col("prefix").alias("__part"))
        hits = seen.join(keys, (F.col("__prefix") == F.col("__part")) & F.col("__key").eqNullSafe(F.col("__new")), "left_semi")
        new = new.join(hits.select("__key"), F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    new.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)
    close(spark, folder)
    _remove(spark, staged)
    return True


def read_new(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The distinct rows of all closed epochs."""
    return _read(spark, path, _live(spark, path)[1], schema)


def merge_epochs(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Write the table of ``append_new`` as one folder, so that a look-up does
    not open the files of every epoch there ever was. Returns the last epoch
    merged. What the merge before this one replaced is removed; what this one
    replaces stays, as a reader may have listed it."""
    upto, folders = _live(spark, path)
    epochs, merges = _epochs(spark, path)
    last = max([upto, *epochs])
    if last > upto:
        full = T.StructType([*schema.fields, T.StructField("prefix", T.StringType())])
        target = f"{path}/epoch={-last - 1}"
        _read(spark, path, folders, full).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(target)
        close(spark, target)
        for e, f in epochs.items():
            if e <= upto:
                _remove(spark, f)
        for e, f in merges.items():
            if e < upto:
                _remove(spark, f)
    return last
