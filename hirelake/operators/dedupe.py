"""Keyed dedupe.

Keep-one-row-per-key is written as a ``min_by``/``max_by`` aggregate over a
struct of the row rather than a ``row_number`` window: the aggregate is
partial (map-side), so a hot key that holds a third of all rows is reduced to
one row per map task before the shuffle and no task holds a whole group.
Spark runs struct-valued buffers as a sort-based aggregate, which spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], latest: bool) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others]) if others else F.lit(None)
    ordk = F.struct(*[F.col(c) for c in order])
    fn = F.max_by if latest else F.min_by
    out = df.groupBy(*keys).agg(fn(row, ordk).alias("__row"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in others])


def latest_version(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order`` tuple
    (e.g. ``[version, crawled_at, job_hash]`` — a total order is required)."""
    return _pick(df, keys, order, latest=True)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the smallest ``order`` tuple."""
    return _pick(df, keys, order, latest=False)


def dedup_by_hash(df: DataFrame, hash_col: str, seq: str) -> DataFrame:
    """Distinct by hash with a deterministic (first-seen) winner."""
    return keep_first(df, [hash_col], [seq, hash_col])


def dedup_hosts(hosts: DataFrame, host: str = "subdomain", method: str = "method",
                seq: str = "seq", method_order: list[str] | None = None) -> DataFrame:
    """Union of host sources, keep the first occurrence per host by
    method order (crt, dns, harvester) then source position."""
    from hirelake.functions.rules import HOST_METHOD_ORDER
    order = method_order or HOST_METHOD_ORDER
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col(method))
    ranked = hosts.withColumn("__rank", rank)
    out = keep_first(ranked, [host], ["__rank", seq])
    return out.drop("__rank")


def seen_window(df: DataFrame, key: str, seen: str, salts: int = 16) -> DataFrame:
    """first/last seen per key attached to every row: a partial
    aggregate, then a join back on (key, salt). The rows of a key are dealt
    over ``salts`` tasks (a join with an aggregate on its own key is not split
    at run time); only keys with more than one row are copied for each salt,
    a row alone with its key is its own first and last."""
    agg = (df.groupBy(key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("__n"))
           .filter((F.col("__n") > 1) & F.col(key).isNotNull()).drop("__n")
           .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(seen)), F.lit(salts)).cast("int"))
    out = salted.join(agg, [key, "__salt"], "left").drop("__salt")
    alone = F.when(F.col(key).isNotNull(), F.col(seen))
    return out.withColumn("first_seen", F.coalesce("first_seen", alone)).withColumn("last_seen", F.coalesce("last_seen", alone))
