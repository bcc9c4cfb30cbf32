"""Sequence numbers, batches and top-n.

A global ``row_number()`` window without ``partitionBy`` moves every row to
one task. ``global_index`` sorts by ranges instead and writes the sorted rows
once, each with its partition and its position in it; the written table is
what both later branches read. (Two branches that sort on their own sample
their own range bounds as soon as one of them has its columns pruned, and
then disagree.) One row per partition is enough to add up where each
partition starts, so that table is bounded by the partition count and is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import scratch_path

_LOCAL_BITS = 33


def global_index(df: DataFrame, order: list, name: str = "idx", partitions: int | None = None,
                 keep_range: bool = False) -> DataFrame:
    """0-based position of every row in ``order`` (which must be total). With
    ``keep_range`` the number of the row's range follows as ``__pid``."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ordered")
    mid = F.monotonically_increasing_id()
    (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .withColumn("__pid", F.shiftright(mid, _LOCAL_BITS))
     .withColumn("__local", mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
     .write.parquet(path))
    tagged = spark.read.parquet(path)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    out = tagged.join(F.broadcast(offsets), "__pid")
    kept = ["__pid"] if keep_range else []
    return out.select(*df.columns, (F.col("__off") + F.col("__local")).alias(name), *kept)


def group_index(df: DataFrame, group: list[str], order: list, name: str = "idx") -> DataFrame:
    """0-based position inside each group. Built on ``global_index`` over
    (group, order), so a hot group is spread over many ranges instead of one
    window task; the group start is subtracted afterwards. The starts meet the
    rows by (range, group): no key holds more rows than a range."""
    keyed = global_index(df, [F.col(g) for g in group] + list(order), "__g", keep_range=True)
    firsts = keyed.groupBy("__pid", *group).agg(F.min("__g").alias("__first"))  # at most groups + ranges rows
    starts = firsts.withColumn("__start", F.min("__first").over(Window.partitionBy(*group))).select(
        F.col("__pid").alias("__at"), *[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], "__start")
    on = F.col("__pid") == F.col("__at")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__k{i}"))
    found = keyed.join(starts, on)
    return found.select(*df.columns, (F.col("__g") - F.col("__start")).alias(name))


def batches(df: DataFrame, size: int, order: list, group: list[str] | None = None, name: str = "batch_id") -> DataFrame:
    """Fixed-size batches over an order (optionally per group)."""
    idx = group_index(df, group, order, "seq") if group else global_index(df, order, "seq")
    return idx.withColumn(name, F.floor(F.col("seq") / F.lit(size)).cast("long"))


def top_n(df: DataFrame, group: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """E5: first ``n`` rows per group. ``row_number() <= n`` is planned with a
    partial per-partition group limit before the shuffle, so a hot group
    ships at most ``n`` rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
