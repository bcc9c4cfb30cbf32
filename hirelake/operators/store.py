"""Sinks and row shapes of the stores.

Writes are partitioned by month of a timestamp column, so reads that filter
on it prune whole folders; rows are sorted within partitions on the store's
sort key instead of a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions import scalars as S


def raw_page_rows(pages: DataFrame, crawled_at, url: str = "url", html: str = "html") -> DataFrame:
    """A3: raw-page rows: id = sha256(url), status ``success``, crawl month."""
    ts = S.clock(crawled_at)
    return pages.select(S.url_hash(url).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        ts.alias("crawled_at"), F.lit("success").alias("status"),
                        F.lit(None).cast("string").alias("error_message"), S.year_month(ts).alias("crawl_ym"))


def write_month_partitioned(df: DataFrame, path: str, ts_col: str, part_col: str = "ym",
                            sort_cols: list[str] | None = None, mode: str = "append",
                            partitions: int | None = None) -> None:
    """Month-partitioned Parquet layout (``yyyyMM`` folders), rows sorted
    within each file by the store's sort key for min/max skipping. Rows are
    range-partitioned on (month, sort key), not hashed on the month, so a
    month holding a third of all rows is written by many tasks, not one."""
    keys = [part_col] + list(sort_cols or [ts_col])
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn(part_col, S.year_month(ts_col)).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    out.write.mode(mode).partitionBy(part_col).parquet(path)


def upsert_table(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert by key = union + latest row per key (see ``latest_version``)."""
    from hirelake.operators.dedupe import latest_version
    return latest_version(target.unionByName(updates, allowMissingColumns=True), keys, order)
