"""Joins of the discovery side.

No side is broadcast by hint unless its size is bounded by construction
(keyword literals, a page of search hits); everything else is left to
Catalyst's size estimate and AQE's runtime conversion, which only
broadcast what they measured under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions import rules
from hirelake.session import materialised


def targets(urls: DataFrame, companies: DataFrame, queue: DataFrame) -> DataFrame:
    """Active pending URLs with their company and queue state,
    excluding URLs whose queue row is not pending. ``target_order`` is the
    row store's order, for a caller who pages through the result."""
    u = urls.filter(F.col("is_active") & (F.col("crawl_status") == "pending"))
    c = companies.select(F.col("id").alias("__cid"), F.col("name").alias("company_name"),
                         F.col("domain").alias("company_domain"))
    q = queue.select(F.col("url_id").alias("__qid"), F.col("status").alias("queue_status"),
                     "retry_count")
    j = (u.join(c, u.company_id == c.__cid, "left").join(q, u.id == q.__qid, "left")
         .filter(F.col("queue_status").isNull() | (F.col("queue_status") == "pending")))
    return (j.select("id", "url", "ats_platform", "page_type", "confidence", "priority",
                     "company_name", "company_domain", F.col("queue_status").alias("crawl_status"),
                     "retry_count", "discovered_at"))


def target_order() -> list:
    """Priority DESC, discovered DESC, NULLs first, then the id."""
    return [F.col("priority").desc_nulls_first(), F.col("discovered_at").desc_nulls_first(), F.col("id").asc()]


def first_company_per_domain(companies: DataFrame) -> DataFrame:
    """One company per domain: the lowest id (the row store's first match)."""
    return companies.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.min_by(F.struct("id", "name"), F.col("id")).alias("c")) \
        .select("domain", F.col("c.id").alias("company_id"), F.col("c.name").alias("company_name"))


def attach_company(urls: DataFrame, companies: DataFrame) -> DataFrame:
    """Company id by the URL's domain, first match, NULL when none. The
    first companies are written (one row a domain): a join with an aggregate
    on its own key is not split at run time, one with a table is, so a domain
    that holds most URLs takes many tasks."""
    firsts = materialised(first_company_per_domain(companies).select("domain", "company_id"), "firsts")
    return urls.join(firsts, "domain", "left")


def name_of(urls: DataFrame, companies: DataFrame) -> DataFrame:
    """Display name per URL domain, first matching company's name, else
    the domain itself."""
    doms = urls.select("domain").distinct()
    firsts = first_company_per_domain(companies).select("domain", "company_name")
    return doms.join(firsts, "domain", "left").select(
        "domain", F.coalesce(F.col("company_name"), F.col("domain")).alias("company_name"))


def candidates(domains: DataFrame, domain: str = "domain") -> DataFrame:
    """Candidate career URLs per domain — each career keyword as a
    subdomain and as a path, each job-host keyword as a DNS name. The
    keyword lists are fixed literals, so this is an ``explode`` of a literal
    array per row (no join, no shuffle)."""
    d = F.col(domain)
    items = []
    for kw in rules.CAREER_KEYWORDS:
        items.append(F.struct(F.lit("subdomain").alias("kind"), F.lit(kw).alias("keyword"),
                              F.concat(F.lit(f"https://{kw}."), d).alias("candidate")))
    for kw in rules.CAREER_KEYWORDS:
        items.append(F.struct(F.lit("path").alias("kind"), F.lit(kw).alias("keyword"),
                              F.concat(F.lit("https://"), d, F.lit(f"/{kw}")).alias("candidate")))
    for kw in rules.JOB_HOST_KEYWORDS:
        items.append(F.struct(F.lit("dns").alias("kind"), F.lit(kw).alias("keyword"),
                              F.concat(F.lit(f"{kw}."), d).alias("candidate")))
    return domains.select(d.alias("domain"), F.inline(F.array(*items)))


def query_templates(keywords: DataFrame, keyword: str = "keyword", templates: list[str] | None = None) -> DataFrame:
    """Every keyword expanded through a template list (``{kw}`` marks
    the keyword; a template without it is the same query for every keyword).
    A literal array exploded per keyword row: no join."""
    k = F.col(keyword)
    items = []
    for i, t in enumerate(templates or rules.KEYWORD_QUERY_TEMPLATES):
        parts = t.split("{kw}")
        text = F.lit(t) if len(parts) == 1 else F.concat(F.lit(parts[0]), k, F.lit(parts[1]))
        items.append(F.struct(F.lit(i).alias("template_id"), text.alias("query")))
    return keywords.select(k.alias("keyword"), F.inline(F.array(*items)))


def dork_templates() -> list[str]:
    """The discovery service's list per keyword: the base queries, then the
    keyword queries."""
    return rules.QUERY_TEMPLATES_BASE + rules.QUERY_TEMPLATES_KEYWORD


def probe(cands: DataFrame, fetch_log: DataFrame, cand_col: str = "candidate", url_col: str = "url") -> DataFrame:
    """Candidate URLs matched to the fetch log that replaced live probing."""
    return cands.join(fetch_log, cands[cand_col] == fetch_log[url_col], "inner")


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """A page of search hits joined to full rows; whether the page is
    broadcast is left to its measured size."""
    return rows.join(hits, key, "inner")


def follow(links: DataFrame, pages: DataFrame, link_url: str = "url", page_url: str = "url") -> DataFrame:
    """Linked pages of each page's selected links (hash join on URL,
    never on host, so one big site does not land in one task)."""
    l2 = links.withColumnRenamed(link_url, "__link")
    p2 = pages.withColumnRenamed(page_url, "__link")
    return l2.join(p2, "__link", "inner").withColumnRenamed("__link", "linked_url")
