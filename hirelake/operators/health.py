"""Per-key health state from success/failure events.

State machine of the source, per key in event order: a success increments
``success_count``, resets ``fail_count`` to 0 and marks healthy; a failure
increments ``fail_count`` and marks unhealthy once it reaches 3. The final
state depends on the last success only.

The events are scanned once and grouped by key *and time bucket*: successes,
failures, and the failures after the bucket's last success. Only these bucket
rows meet by key afterwards: the failures of the buckets after the last one
with a success are added to that bucket's own. A key with a third of all
events is spread over its buckets, so no task holds its events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators.sequence import global_index
from hirelake.session import materialised

FAIL_LIMIT = 3


def time_bucket(df: DataFrame, col: str) -> Column:
    """The hour of a timestamp; of a number, its thousands."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc("hour", F.col(col))
    return F.floor(F.col(col) / 1000)


def health_fold(events: DataFrame, key: str, order: list[str], is_success, is_failure,
                initial_healthy: bool = True, bucket: Column | None = None) -> DataFrame:
    """Final (success_count, fail_count, is_healthy) per key. ``order`` is a
    total order; ``bucket`` must rise with its first column (default: the
    hour)."""
    b = bucket if bucket is not None else time_bucket(events, order[0])
    ev = events.select(F.col(key).alias(key), b.alias("__b"), F.struct(*[F.col(c) for c in order]).alias("__o"),
                       is_success.alias("__s"), is_failure.alias("__f")).filter(F.col("__s") | F.col("__f"))
    w = Window.partitionBy(key, "__b")
    ev = ev.withColumn("__last", F.max(F.when(F.col("__s"), F.col("__o"))).over(w))
    after = F.col("__f") & (F.col("__last").isNull() | (F.col("__o") > F.col("__last")))
    parts = ev.groupBy(key, "__b").agg(F.count_if("__s").alias("__ns"), F.count_if(after).alias("__nf"))
    won = F.max(F.when(F.col("__ns") > 0, F.col("__b"))).over(Window.partitionBy(key))  # over a key's hours
    late = F.col("__won").isNull() | (F.col("__b") >= F.col("__won"))
    out = parts.withColumn("__won", won).groupBy(key).agg(
        F.sum("__ns").alias("success_count"), F.max("__won").alias("__won"),
        F.sum(F.when(late, F.col("__nf")).otherwise(0)).cast("long").alias("fail_count"))
    healthy = F.col("fail_count") < FAIL_LIMIT
    if not initial_healthy:
        healthy = healthy & F.col("__won").isNotNull()
    return out.select(key, F.col("success_count").cast("long").alias("success_count"), "fail_count",
                      healthy.alias("is_healthy"))


def health_timeline(events: DataFrame, key: str, order: list[str], is_success, is_failure,
                    initial_healthy: bool = True, partitions: int | None = None) -> DataFrame:
    """E7 after every event: ``events``' successes and failures with the key's
    ``success_count``, ``fail_count`` (since its last success) and
    ``is_healthy`` once that event is applied.

    A prefix scan in segments: the events are sorted by ranges of (key, order)
    and written with their range, so a key with a third of all events covers a
    third of the ranges. Windows run inside (key, range). What a range hands on
    to the next one of the same key (successes, failures after the last
    success) is one row per key and range, at most keys + ranges rows; those
    are scanned per key and added to the rows of their range."""
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ev = events.withColumn("__s", F.coalesce(is_success, F.lit(False))).withColumn("__f", F.coalesce(is_failure, F.lit(False)))
    ev = ev.filter(F.col("__s") | F.col("__f"))
    ranges = ev.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    ev = materialised(ranges.withColumn("__at", F.spark_partition_id()), "timeline")
    so_far = Window.partitionBy(key, "__at").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("__ns", F.count_if("__s").over(so_far)).withColumn("__nf", F.count_if("__f").over(so_far))
    ev = ev.withColumn("__since", F.col("__nf") - F.coalesce(F.max(F.when(F.col("__s"), F.col("__nf"))).over(so_far), F.lit(0)))
    # the last row of a range holds what it hands on
    handed = ev.groupBy(key, "__at").agg(
        F.max("__ns").alias("__won"), F.max_by("__since", F.col("__ns") + F.col("__nf")).alias("__lost"))
    before = Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    runs = handed.withColumn("__run", F.coalesce(F.count_if(F.col("__won") > 0).over(
        Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    # failures add up from a range with a success on, up to the next such range
    upto = Window.partitionBy(key, "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("__sum", F.sum("__lost").over(upto))
    carry = runs.select(F.col(key).alias("__key"), F.col("__at").alias("__of"),
                        F.coalesce(F.sum("__won").over(before), F.lit(0)).alias("__s0"),
                        F.coalesce(F.lag("__sum").over(Window.partitionBy(key).orderBy("__at")), F.lit(0)).alias("__f0"))
    out = ev.join(carry, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__at") == F.col("__of")))
    total = F.col("__ns") + F.col("__s0")
    lost = F.col("__since") + F.when(F.col("__ns") > 0, 0).otherwise(F.col("__f0"))
    out = out.withColumn("success_count", total.cast("long")).withColumn("fail_count", lost.cast("long"))
    healthy = F.col("fail_count") < FAIL_LIMIT
    if not initial_healthy:
        healthy = healthy & (F.col("success_count") > 0)
    return out.select(*events.columns, "success_count", "fail_count", healthy.alias("is_healthy"))


def assign(requests: DataFrame, pool: DataFrame, request_order: list, pool_order: list, member: str,
           name: str = "assigned") -> DataFrame:
    """Each request, in order, gets the next usable member of the pool.
    The cursor starts behind the first place of the pool, so the member at
    place 1 comes first and place 0 last; members that are not usable are
    passed over. ``assigned`` is null where no member is usable.

    Both sides are numbered by range sorts; a request meets its member by an
    equi-join on its number modulo the number of usable members. A small pool
    is broadcast where the planner measures it as small; a large one gives as
    many join keys as it has members."""
    placed = global_index(pool, pool_order, "__place")
    size = placed.agg(F.count(F.lit(1))).first()[0]
    usable = eligible(placed).withColumn("__turn", F.pmod(F.col("__place") - 1, F.lit(max(size, 1))))
    usable = global_index(usable, [F.col("__turn")], "__rank").select(F.col(member).alias(name), "__rank")
    n = usable.agg(F.count(F.lit(1))).first()[0]
    numbered = global_index(requests, request_order, "__no")
    turn = F.pmod(F.col("__no"), F.lit(n)) if n else F.lit(None).cast("long")
    return numbered.join(usable, turn == F.col("__rank"), "left").select(*requests.columns, name)


def eligible(pool: DataFrame, country: str | None = None) -> DataFrame:
    """Usable members (healthy or fewer than 3 failures), optional country."""
    df = pool.filter(F.col("is_healthy") | (F.col("fail_count") < FAIL_LIMIT))
    if country is not None:
        df = df.filter(F.col("country") == country)
    return df
