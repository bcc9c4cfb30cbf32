"""The crawl of career pages as one plan.

pages -> job links (numbered within each page) -> linked pages (equi-join on the
URL) -> parse -> postings numbered within their career page's batch -> one
result row per career page. The shuffles go by career page and by link; both keys are
high-cardinality, and a page holds few links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.operators import html as H

_KEY = "page_id long, page_url string, company string, pos int"


def followed_links(pages: DataFrame, follow: int | None = None) -> DataFrame:
    """``(page_id, page_url, pos, url, title)``: each career page's job links
    in page order, the first ``follow`` of them if given."""
    return H.numbered_job_links(H.extract_pages(pages), follow)


def linked_postings(links: DataFrame, store: DataFrame, pages: DataFrame) -> DataFrame:
    """The linked pages found in ``store`` (``url, html``), parsed: the parse
    columns plus ``page_id, page_url, company_name, pos`` of the career page
    and place they were linked from. The link travels as the page's text id,
    so nothing has to be joined back."""
    names = pages.select(F.col("page_id").alias("__pid"), "company_name")
    hits = (links.join(store.select(F.col("url").alias("__url"), "html"), F.col("url") == F.col("__url"))
            .join(names, F.col("page_id") == F.col("__pid")))
    key = F.to_json(F.struct("page_id", "page_url", F.col("company_name").alias("company"), F.col("pos")))
    parsed = H.parse_cascade(H.extract_pages(hits.select(key.alias("page_id"), "url", "html")))
    k = F.from_json("page_id", _KEY)
    return parsed.withColumn("__k", k).select(
        *[c for c in parsed.columns if c != "page_id"], F.col("__k.page_id").alias("page_id"),
        F.col("__k.page_url").alias("page_url"), F.col("__k.company").alias("company_name"), F.col("__k.pos").alias("pos"))


def store_batches(parsed: DataFrame, crawled_at, epoch: int) -> DataFrame:
    """A5: the usable postings in the row shape of the jobs table, with their
    career page; positions count the usable ones of a page, from 0."""
    ok = parsed.filter(F.col("parse_strategy").isin("jsonld", "heuristics"))
    w = Window.partitionBy("page_id").orderBy("pos")  # a page's few links
    ok = ok.withColumn("batch_pos", F.row_number().over(w) - 1)
    return H.normalise_postings(ok, crawled_at=crawled_at, epoch=epoch, company_name=F.col("company_name"),
                                batch_url="page_url", batch_pos="batch_pos")


def crawl_results(pages: DataFrame, links: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per career page the links followed, the linked pages fetched, the
    postings stored, and success: a page succeeds when it could be fetched,
    also without links or postings."""
    usable = F.col("parse_strategy").isin("jsonld", "heuristics")
    marks = (links.select("page_id", F.lit(1).alias("l"), F.lit(0).alias("f"), F.lit(0).alias("s"))
             .unionByName(parsed.select("page_id", F.lit(0).alias("l"), F.lit(1).alias("f"), usable.cast("int").alias("s"))))
    n = marks.groupBy("page_id").agg(F.sum("l").alias("links_followed"), F.sum("f").alias("pages_fetched"),
                                     F.sum("s").alias("jobs_stored"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("links_followed", "pages_fetched", "jobs_stored")]
    return pages.select("page_id", (F.col("html") != "").alias("success")).join(n, "page_id", "left").select(
        "page_id", *zero, "success")
