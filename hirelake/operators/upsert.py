"""Upserts, seeding and existence checks.

Upsert by key = union of the existing rows and the new rows, each tagged with
an arrival sequence, then one (partial, map-side) aggregate per key. Every rule of the
source's ``ON CONFLICT`` clauses becomes an aggregate: GREATEST -> ``max``
(NULL ignored), keep-first -> ``min_by(seq)``, overwrite -> ``max_by(seq)``,
``COALESCE(new, old)`` -> ``max_by`` over rows whose new value is not NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.session import materialised


def _seq_union(existing: DataFrame, incoming: DataFrame, seq: str) -> DataFrame:
    # existing rows come before every incoming row
    a = existing.withColumn("__src", F.lit(0))
    b = incoming.withColumn("__src", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).withColumn(
        "__ord", F.struct(F.col("__src"), F.col(seq)))


def upsert_urls(existing: DataFrame, incoming: DataFrame, key: str = "url_hash",
                seq: str = "seq", greatest: tuple[str, ...] = ("confidence", "priority")) -> DataFrame:
    """Per key, ``confidence``/``priority`` take the greatest non-NULL
    value; every other column keeps its first-seen value."""
    u = _seq_union(existing, incoming, seq)
    others = [c for c in existing.columns if c not in (key, *greatest)]
    aggs = [F.max(c).alias(c) for c in greatest]
    aggs += [F.min_by(F.col(c), F.col("__ord")).alias(c) for c in others]
    return u.groupBy(key).agg(*aggs).select(*existing.columns)


def upsert_companies(existing: DataFrame, incoming: DataFrame, key: str = "domain",
                     seq: str = "seq") -> DataFrame:
    """Per domain the newest ``name`` wins, ``description`` is
    ``COALESCE(new, old)`` (an empty string is a value and overwrites), and
    the remaining columns (id, source, ...) keep their first values."""
    u = _seq_union(existing, incoming, seq)
    keep = [c for c in existing.columns if c not in (key, "name", "description")]
    aggs = [F.max_by("name", "__ord").alias("name"),
            F.max_by("description", F.when(F.col("description").isNotNull(), F.col("__ord")))
            .alias("description")]
    aggs += [F.min_by(F.col(c), F.col("__ord")).alias(c) for c in keep]
    return u.groupBy(key).agg(*aggs).select(*existing.columns)


def new_only(src: DataFrame, target: DataFrame, key: str, target_key: str | None = None) -> DataFrame:
    """C4: rows of ``src`` whose key is absent from ``target`` (anti join)."""
    tk = target_key or key
    return src.join(target.select(F.col(tk).alias("__k")), src[key] == F.col("__k"), "left_anti")


def seed(target: DataFrame, seeds: DataFrame, key: str, target_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert-if-absent. Returns (rows to add, one-row counts added/skipped)."""
    added = new_only(seeds, target, key, target_key)
    counts = seeds.join(
        target.select(F.col(target_key or key).alias("__k")).distinct().withColumn("__hit", F.lit(True)),
        seeds[key] == F.col("__k"), "left").agg(
        F.count_if(F.col("__hit").isNull()).alias("added"),
        F.count_if(F.col("__hit").isNotNull()).alias("skipped"))
    return added, counts


def mark_seen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """C11: flag each new row whose key already exists in ``old``: the rows of a
    semi join and those of the anti join, over the same two exchanges. Both are
    plain joins, which run-time splitting takes apart where a key is hot."""
    k = old.select(F.col(key).alias("__k"))
    there = new.join(k, new[key] == k["__k"], "left_semi").withColumn("seen", F.lit(True))
    return there.unionByName(new.join(k, new[key] == k["__k"], "left_anti").withColumn("seen", F.lit(False)))


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent survives (semi join)."""
    return child.join(parent.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"),
                      "left_semi")


def cascade_all(edges: DataFrame, deleted: DataFrame, max_levels: int | None = None) -> DataFrame:
    """C5 over all levels: ``(kind, key, level)`` of every row that goes when
    the rows ``(kind, key)`` of ``deleted`` go. ``edges`` names each child's
    parent: ``(kind, key, parent_kind, parent_key)``; a child with several
    parents goes with the first of them, on the lowest level.

    Level by level: the children of what the last level took, less what is
    gone already, so a cycle ends. Each level is written, and is the join side
    of the next; the edges are read once a level and a level ends the lineage.
    ``max_levels`` bounds the levels of a caller who knows their number."""
    level = 0
    gone = materialised(deleted.select("kind", "key").distinct().withColumn("level", F.lit(0)), "cascade")
    last = gone
    while max_levels is None or level < max_levels:
        level += 1
        up = last.select(F.col("kind").alias("__k"), F.col("key").alias("__v"))
        found = edges.join(up, (F.col("parent_kind") == F.col("__k")) & (F.col("parent_key") == F.col("__v")), "left_semi")
        found = found.select("kind", "key").distinct().join(gone.select("kind", "key"), ["kind", "key"], "left_anti")
        last = materialised(found.withColumn("level", F.lit(level)), "cascade")
        if last.isEmpty():
            break
        gone = gone.unionByName(last)
    return gone
