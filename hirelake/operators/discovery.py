"""Discovery jobs re-aimed at tables of responses.

Live network calls of the source (CT logs, DNS, search APIs, fetching) are
replaced by tables of their responses; these operators do the parsing,
filtering and scoring of those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.functions import predicates as P
from hirelake.functions import rules
from hirelake.functions import scalars as S
from hirelake.operators.stored import append_once, read_appended
from hirelake.session import materialised

EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def site_domain(host) -> F.Column:
    """Host without a leading www./m./blog. label."""
    return F.regexp_replace(S._c(host), r"^(www|m|blog)\.", "")


def ct_hosts(entries: DataFrame, domain: str = "domain", name_value: str = "name_value") -> DataFrame:
    """Certificate-log entries -> hosts. Each entry's name list is split on
    newlines, stripped, wildcard ``*.`` removed, kept when it ends with the
    domain, flagged when job related."""
    lines = entries.select(domain, F.posexplode(F.split(F.col(name_value), "\n")).alias("line_pos", "raw"),
                           *[c for c in entries.columns if c not in (domain, name_value)])
    host = F.replace(S.strip_ws("raw"), F.lit("*."), F.lit(""))
    out = lines.withColumn("subdomain", host).filter(
        (F.col("subdomain") != "") & P.host_in_domain_suffix("subdomain", domain))
    return out.select(*[c for c in out.columns if c != "raw"]).withColumn("method", F.lit("crt")) \
        .withColumn("is_job_related", P.job_related_host("subdomain"))


def harvest_hosts(raw: DataFrame, domain: str = "domain", host: str = "raw_host") -> DataFrame:
    """Harvested host names -> lower/strip, keep those containing the domain."""
    h = S.lower_trim(host)
    out = raw.withColumn("subdomain", h).filter((F.col("subdomain") != "") & P.host_in_domain_contains("subdomain", domain))
    return out.drop(host).withColumn("method", F.lit("theharvester")) \
        .withColumn("is_job_related", P.job_related_host("subdomain"))


def host_pages(hosts: DataFrame) -> DataFrame:
    """Host -> candidate page (https URL, page_type ``subdomain``,
    confidence/priority from the job-related flag)."""
    pr = P.host_priority("is_job_related")
    return hosts.select("*", F.concat(F.lit("https://"), F.col("subdomain")).alias("url"),
                        F.lit("subdomain").alias("page_type"),
                        pr["confidence"].alias("confidence"), pr["priority"].alias("priority"))


def score_career_pages(fetched: DataFrame, url: str = "url", content: str = "content",
                       status: str = "status", kind: str = "kind") -> DataFrame:
    """I8: fetched candidate pages -> career pages. A page counts when it
    answered 200 and mentions at least two distinct career keywords;
    confidence is ``min(0.5 + 0.1 n, 1)`` for subdomain candidates and
    ``min(0.6 + 0.1 n, 1)`` for path candidates; page_type is the keyword
    (first host label, or the path)."""
    n = P.career_keyword_count(content)
    is_sub = F.col(kind) == "subdomain"
    page_type = F.when(is_sub, F.split(S.url_host(url), r"\.")[0]).otherwise(
        F.regexp_replace(F.regexp_extract(S.url_path(url), r"^/([^/]*)", 1), r"^/+|/+$", ""))
    out = fetched.withColumn("n_keywords", n).filter((F.col(status) == 200) & (F.col("n_keywords") >= 2))
    return out.select(url, page_type.alias("page_type"),
                      F.when(is_sub, S.keyword_confidence("n_keywords", 0.5))
                      .otherwise(S.keyword_confidence("n_keywords", 0.6)).alias("confidence"),
                      F.col(kind).alias("discovered_via"), "n_keywords")


def extract_emails(df: DataFrame, text: str = "text") -> DataFrame:
    """Email addresses found in a text column, lower-cased and stripped."""
    e = df.select("*", F.explode(F.regexp_extract_all(F.col(text), F.lit(EMAIL_RE), 0)).alias("__e"))
    return e.withColumn("email", S.lower_trim("__e")).drop("__e")


def clean_harvested_emails(harvested: DataFrame, domain: str = "domain", email: str = "raw_email") -> DataFrame:
    """Emails harvested for a domain -> lower/strip, keep those
    that contain the domain, distinct per domain. Row-wise filter plus one
    distinct: no join, so no (email, domain) pairs are ever generated. The
    result stays in long form (one row per domain and email), read sorted."""
    e = harvested.select(F.col(domain).alias("domain"), S.lower_trim(email).alias("email"))
    return e.filter((F.col("email") != "") & F.contains(F.col("email"), F.lower(F.col("domain")))).distinct()


def org_to_company(records: DataFrame, json_col: str = "body") -> DataFrame:
    """Code-host organisation record -> company row (name falls
    back to the login when missing or empty; metadata as JSON)."""
    schema = T.StructType([
        T.StructField("login", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("blog", T.StringType()), T.StructField("bio", T.StringType()),
        T.StructField("html_url", T.StringType()), T.StructField("public_repos", T.LongType()),
        T.StructField("followers", T.LongType())])
    r = records.withColumn("__o", F.from_json(F.col(json_col), schema))
    o = F.col("__o")
    meta = F.to_json(F.struct(o["html_url"].alias("github_url"),
                              F.coalesce(o["public_repos"], F.lit(0)).alias("repos"),
                              F.coalesce(o["followers"], F.lit(0)).alias("followers")))
    return r.select(*[c for c in records.columns if c != json_col],
                    S.fill_blank(o["name"], o["login"]).alias("name"),
                    o["blog"].alias("domain"), o["bio"].alias("description"),
                    F.lit("github").alias("source"), meta.alias("metadata"))


def result_rows(responses: DataFrame, json_col: str = "body", limit: int | None = None) -> DataFrame:
    """Search-API response -> one row per organic result with
    rank = position + 1; missing fields become ''; with ``limit`` only the
    first so many results of each response."""
    item = T.StructType([T.StructField("link", T.StringType()), T.StructField("title", T.StringType()),
                         T.StructField("snippet", T.StringType())])
    schema = T.StructType([T.StructField("organic_results", T.ArrayType(item))])
    parsed = responses.withColumn("__r", F.from_json(F.col(json_col), schema))
    rows = parsed.select(*[c for c in responses.columns if c != json_col],
                         F.posexplode(F.col("__r.organic_results")).alias("__pos", "__it"))
    if limit is not None:
        rows = rows.filter(F.col("__pos") < limit)
    return rows.select(
        *[c for c in responses.columns if c != json_col],
        F.coalesce(F.col("__it.link"), F.lit("")).alias("url"),
        F.coalesce(F.col("__it.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("__it.snippet"), F.lit("")).alias("snippet"),
        (F.col("__pos") + 1).cast("int").alias("rank"))


def tag_results(df: DataFrame, url: str = "url", content: str | None = None) -> DataFrame:
    """ATS tag for result URLs (URL rules, then content rules); domain
    stays empty and priority is 1, as in the source."""
    a = P.ats_classify(url, content)
    return df.select("*", a["is_ats"].alias("is_ats"), a["platform"].alias("ats_platform"),
                     a["confidence"].alias("confidence"), F.lit(1).alias("priority"),
                     F.lit("").alias("domain_hint"))


def classify_fetch(log: DataFrame, status: str = "status") -> DataFrame:
    """Success flag (status < 400); failed rows keep their row with
    empty html and an error text instead of being dropped."""
    ok = P.fetch_ok(status)
    return log.select(*[c for c in log.columns if c != "html"],
                      ok.alias("success"),
                      F.when(ok, F.col("html")).otherwise(F.lit("")).alias("html"),
                      F.when(ok, F.lit(None).cast("string"))
                      .otherwise(F.concat(F.lit("HTTP "), F.col(status).cast("string"))).alias("error"),
                      (F.col(status) < 500).alias("host_alive"))


def batch_summary(log: DataFrame) -> DataFrame:
    """Requested, ok and failed counts."""
    return log.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("success")).alias("ok"),
                   F.count_if(~F.col("success")).alias("failed"))


def decode_fetch_response(bodies: DataFrame, json_col: str = "body") -> DataFrame:
    """Fetch-service response body (JSON array of url/html/error/success)
    -> one row per fetched page."""
    item = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                         T.StructField("error", T.StringType()), T.StructField("success", T.BooleanType())])
    arr = F.from_json(F.col(json_col), T.ArrayType(item))
    keep = [c for c in bodies.columns if c != json_col]
    return bodies.select(*keep, F.posexplode(arr).alias("item_pos", "__it")).select(
        *keep, "item_pos", "__it.url", "__it.html", "__it.error", "__it.success")


def attach_emails(pages: DataFrame, emails: DataFrame, domain: str = "domain") -> DataFrame:
    """``pages`` with the sorted distinct ``emails`` of their domain, an
    empty array where it has none. ``emails`` is ``(domain, email)``. An array
    holds one domain's addresses; it is built once, written, and joined, so a
    domain with most pages is split at run time."""
    each = emails.groupBy(F.col(domain).alias("__domain")).agg(F.array_sort(F.collect_set("email")).alias("__emails"))
    known = materialised(each, "emails")
    out = pages.join(known, F.col(domain) == F.col("__domain"), "left")
    return out.select(*pages.columns, F.coalesce("__emails", F.array().cast("array<string>")).alias("emails"))


def by_method(df: DataFrame, methods: list[str], col: str = "method") -> DataFrame:
    """Keep the rows of the requested methods/sources; unknown names are
    an error (the source rejects unknown sources)."""
    known = set(rules.HOST_METHOD_ORDER) | {"github", "google_dork", "manual"}
    bad = [m for m in methods if m not in known]
    if bad:
        raise ValueError(f"unknown source/method: {bad}")
    return df.filter(F.col(col).isin(methods))


def dispatch_sources(readers: dict, sources: list[str]) -> DataFrame:
    """L3/G1: run the reader of each requested source and union the company
    rows (``unionByName``), tagging each with its source. A source name with
    no reader is an error, and so is a reader that fails: whether a lazy plan
    fails now or when it runs must not decide which rows come out. A caller
    who wants to go on without a source leaves it out of ``sources``."""
    unknown = [s for s in sources if s not in readers]
    if unknown:
        raise ValueError(f"unknown source: {unknown}")
    if not sources:
        raise ValueError("no source asked for")
    parts = [readers[s]().withColumn("source", F.lit(s)) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dispatch_written(readers: dict, sources: list[str], folder: str) -> tuple[DataFrame, DataFrame]:
    """G1 where a source may fail: ``(rows, statuses)``. Each source is run on
    its own and written to ``folder``; the rows are those of the sources that
    finished, tagged with their source, and every source asked for has a status
    row ``(source, status, rows, error)`` with ``ok`` or ``failed``. What comes out
    is what was written, so it does not matter whether a source failed when
    its plan was made or when it ran, and half a source never counts. A name
    without a reader is an error."""
    if unknown := [s for s in sources if s not in readers]:
        raise ValueError(f"unknown source: {unknown}")
    if not sources:
        raise ValueError("no source asked for")
    statuses, parts = [], []
    spark = SparkSession.active()
    for s in dict.fromkeys(sources):
        try:
            df = readers[s]()
            append_once(df, f"{folder}/{s}", "all")
            done = read_appended(spark, f"{folder}/{s}", df.schema).drop("batch")
            parts.append(done.withColumn("source", F.lit(s)))
            statuses.append((s, "ok", done.count(), None))
        except Exception as e:
            statuses.append((s, "failed", 0, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    report = spark.createDataFrame(statuses, "source string, status string, rows long, error string")
    if not parts:
        return spark.createDataFrame([], "source string"), report
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, report


def host_summary(hosts: DataFrame, host: str = "subdomain", related: str = "is_job_related") -> DataFrame:
    """Distinct hosts found per domain and how many are job related."""
    one = hosts.groupBy("domain", host).agg(F.max(related).alias("__r"))
    return one.groupBy("domain").agg(F.count(F.lit(1)).alias("total_found"), F.count_if("__r").alias("job_related"))


def discovery_totals(companies: DataFrame, pages: DataFrame, queued: DataFrame) -> DataFrame:
    """Companies found, career pages found and URLs queued, over all
    child runs: one partial aggregate over the three inputs' counts."""
    def n(df, name):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    counts = n(companies, "companies_found").unionByName(n(pages, "career_pages_found")).unionByName(n(queued, "urls_queued"))
    return counts.agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).cast("long").alias(w)
                        for w in ("companies_found", "career_pages_found", "urls_queued")])


def career_pages(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """A company's career pages followed by its enumerated hosts, in one
    table (UNION ALL: a host that is a page too stays twice)."""
    cols = ["domain", "url", "page_type", "confidence", "priority"]
    return pages.select(*cols).unionByName(hosts.select(*cols))


def query_result_urls(results: list[DataFrame]) -> DataFrame:
    """The URLs of several search queries, UNION ALL."""
    out = results[0].select("query", "url", "rank")
    for r in results[1:]:
        out = out.unionByName(r.select("query", "url", "rank"))
    return out


def unprocessed(results: DataFrame, processed_col: str = "processed") -> DataFrame:
    """Search results not processed yet."""
    return results.filter(~F.col(processed_col))


def campaign_summary(results: DataFrame, campaign: str, company: str, url: str) -> DataFrame:
    """Per campaign the number of results, distinct companies and URLs."""
    return results.groupBy(campaign).agg(F.count(F.lit(1)).cast("int").alias("total_results"),
                                         F.count_distinct(company).cast("int").alias("companies_found"),
                                         F.count_distinct(url).cast("int").alias("urls_found"))
