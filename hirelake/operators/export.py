"""Search-document export and import tally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields of the search document, in the collection's order.
DOC_FIELDS = ["id", "title", "company", "description", "location", "remote", "salary_min", "salary_max",
              "currency", "job_type", "experience_level", "real_score", "hiring_manager_name",
              "hiring_manager_email", "posted_at", "updated_at", "source_url", "source_platform", "tags"]


def search_documents(jobs: DataFrame) -> DataFrame:
    """One JSON line per posting — optional fields omitted when NULL,
    timestamps as epoch seconds, the flag as boolean, empty tags omitted."""
    cols = []
    for f in DOC_FIELDS:
        if f not in jobs.columns:
            continue
        c = F.col(f)
        if f == "id":
            c = c.cast("string")
        elif f == "remote":
            c = c == 1
        elif f in ("posted_at", "updated_at"):
            c = F.unix_timestamp(c)
        elif f == "tags":
            c = F.when(F.size(c) > 0, c)
        cols.append(c.alias(f))
    return jobs.select(F.col("id").alias("__id"), F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("doc"))


def write_jsonl(docs: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    """Sink: text files of JSON lines, sorted within partitions (no global sort)."""
    (docs.sortWithinPartitions("__id").select("doc").write.mode("overwrite")
     .option("maxRecordsPerFile", records_per_file).text(path))


def import_tally(lines: DataFrame, col: str = "line") -> DataFrame:
    """A10: per-line import responses -> success / error counts; a line that
    is not valid JSON counts as an error."""
    parsed = F.from_json(F.col(col), T.StructType([T.StructField("success", T.BooleanType()),
                                                   T.StructField("error", T.StringType())]))
    ok = F.coalesce(parsed["success"], F.lit(False))
    return lines.agg(F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_error"))
