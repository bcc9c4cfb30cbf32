"""Queries over pages/documents: anchors, job links, JSON-LD, heuristics,
parse cascade, visible text, raw-page sink rows, fetch-response decode."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import rules
from hirelake.functions import scalars as S
from hirelake.operators import discovery as X
from hirelake.operators import html as H
from hirelake.operators import ingest as N
from hirelake.plans import sqlgen as G
from hirelake.plans.registry import query
from hirelake.sources import tables as T

AS_OF_CRAWL = "2024-01-31 00:00:00"


_A_PAT = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


@query("anchors", ids=("I1", "H4", "L4"), sql=f"""
SELECT page_id, pos, href, concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), href) AS abs_url, title AS text
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{_A_PAT}', 1)) AS href,
             unnest(regexp_extract_all(html, '{_A_PAT}', 2)) AS title,
             generate_subscripts(regexp_extract_all(html, '{_A_PAT}', 1), 1) - 1 AS pos FROM pages)""")
def anchors(spark, sf):
    return H.anchors(H.extract_pages(T.spread(T.read_table(spark, sf, "pages")))).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "abs_url", "text")


def _job_pages(spark, sf):
    p = T.spread(T.read_table(spark, sf, "pages"))
    return p.select("page_id", "url", F.replace("html", F.lit('href="/'), F.lit('href="/jobs/1/')).alias("html"))


_LINK_PAT = '<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'
_JOB_LINKS_SQL = """
WITH jp AS (SELECT page_id, url, replace(html, 'href="/', 'href="/jobs/1/') AS html FROM pages),
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '""" + _LINK_PAT + """', 1)) AS href,
             unnest(regexp_extract_all(html, '""" + _LINK_PAT + """', 2)) AS title,
             generate_subscripts(regexp_extract_all(html, '""" + _LINK_PAT + """', 1), 1) - 1 AS pos FROM jp),
r AS (SELECT page_id, url, pos, trim(title) AS title,
             CASE WHEN href LIKE '/%' AND href NOT LIKE '//%'
                  THEN concat(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1), href) ELSE href END AS link_url
      FROM a WHERE href <> ''),
ok AS (SELECT * FROM r
       WHERE (link_url LIKE 'http://%' OR link_url LIKE 'https://%')
         AND regexp_extract(link_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)
         AND NOT """ + G.contains_any("lower(link_url)", rules.SKIP_PATH_PATTERNS) + """
         AND """ + G.contains_any("lower(link_url)", rules.JOB_PATH_PATTERNS) + """
         AND (regexp_matches(link_url, '\\p{Nd}') OR len(string_split(regexp_replace(
              regexp_extract(link_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/')) >= 3)
         AND length(title) BETWEEN 5 AND 200)
SELECT page_id, link_url AS url, arg_min(title, pos) AS title, CAST(min(pos) AS INTEGER) AS pos
FROM ok GROUP BY page_id, link_url"""


@query("job_links", ids=("I2", "E3", "T12", "B12", "B13", "B14", "B15", "B16", "H5"), sql=_JOB_LINKS_SQL)
def job_links(spark, sf):
    return H.job_links(H.extract_pages(_job_pages(spark, sf)))


@query("top_links", ids=("E5", "T17"), sql=_JOB_LINKS_SQL.replace(
    "SELECT page_id, link_url AS url, arg_min(title, pos) AS title, CAST(min(pos) AS INTEGER) AS pos\nFROM ok GROUP BY page_id, link_url",
    """, f AS (SELECT page_id, link_url AS url, min(pos) AS pos FROM ok GROUP BY page_id, link_url)
SELECT page_id, url, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM f) WHERE rn <= 5"""))
def top_links(spark, sf):
    links = H.numbered_job_links(H.extract_pages(_job_pages(spark, sf)), 5)
    return links.select("page_id", "url", (F.col("pos") + 1).alias("rn"))


# ---------------------------------------------------------------- crawl of career pages over the JSON-LD pages

_EPOCH = 1706659200


def _career_pages(spark, sf):
    """A career page per document, which lists the job pages of the document
    and the one after it, one that does not exist, a repeat and other links;
    Spanish ones answered with an empty page."""
    d = T.read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    job = lambda k: F.concat(F.lit("../jobs/"), k.cast("string"))
    links = [job(F.col("doc_id")), job(F.col("doc_id") + 1), job(F.col("doc_id")), F.lit("/about"),
             job(F.col("doc_id") + 1_000_000_000), F.lit("#top"), F.lit("https://other.example.org/jobs/3")]
    html = F.concat(*[F.concat(F.lit('<a href="'), u, F.lit(f'">Opening {i}</a>')) for i, u in enumerate(links)])
    url = F.concat(F.lit("https://careers.example.com/list/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("page_id"), url.alias("url"),
                    F.when(F.col("lang") == "es", F.lit("")).otherwise(html).alias("html"),
                    F.concat(F.lit("Crawl of "), "source").alias("company_name"))


def _job_store(spark, sf):
    return jsonld_pages(spark, sf).select(F.concat(
        F.lit("https://careers.example.com/jobs/"), F.col("page_id").cast("string")).alias("url"), "html")


_CRAWL_SQL = """
WITH job AS (SELECT doc_id, source, p_name, p_size FROM documents JOIN part ON doc_id = p_partkey),
pg AS (SELECT doc_id AS page_id, concat('https://careers.example.com/list/', CAST(doc_id AS VARCHAR)) AS page_url,
              concat('Crawl of ', source) AS company_name, lang FROM documents),
l AS (SELECT pg.*, pos, CASE pos WHEN 0 THEN page_id WHEN 1 THEN page_id + 1 ELSE page_id + 1000000000 END AS target
      FROM pg, (SELECT unnest([0, 1, 2]) AS pos) WHERE lang <> 'es'),
f AS (SELECT l.*, job.source, job.p_name, job.p_size FROM l JOIN job ON job.doc_id = l.target),
st AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS idx,
              CASE WHEN p_size % 7 = 6 THEN company_name ELSE source END AS company,
              concat('https://careers.example.com/jobs/', CAST(target AS VARCHAR)) AS url FROM f WHERE p_size > 5)
"""


@query("ingest_postings", ids=("I15", "A5", "A4", "I7", "H2", "H3", "H20", "H21"), sql=_CRAWL_SQL + f"""
SELECT concat(substr(sha256(page_url), 1, 16), '-', CAST(idx AS VARCHAR), '-{_EPOCH}') AS id,
       sha256(concat(url, p_name, company)) AS job_hash, p_name AS title, company, url AS source_url,
       'career_page' AS source_platform FROM st""")
def ingest_postings(spark, sf):
    pages = _career_pages(spark, sf)
    parsed = N.linked_postings(N.followed_links(pages, follow=5), _job_store(spark, sf), pages)
    return N.store_batches(parsed, AS_OF_CRAWL, _EPOCH).select(
        "id", "job_hash", "title", "company", "source_url", "source_platform")


@query("page_result", ids=("D20", "C10", "I15", "A5"), sql=_CRAWL_SQL + """
SELECT pg.page_id, (SELECT count(*) FROM l WHERE l.page_id = pg.page_id) AS links_followed,
       (SELECT count(*) FROM f WHERE f.page_id = pg.page_id) AS pages_fetched,
       (SELECT count(*) FROM st WHERE st.page_id = pg.page_id) AS jobs_stored, lang <> 'es' AS success FROM pg""")
def page_result(spark, sf):
    pages = _career_pages(spark, sf)
    links = N.followed_links(pages, follow=5)
    return N.crawl_results(pages, links, N.linked_postings(links, _job_store(spark, sf), pages))


# ---------------------------------------------------------------- JSON-LD pages built from documents x part

def _json_str(c):
    """JSON text of one string value (to_json needs a container)."""
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def jsonld_pages(spark, sf):
    """Pages whose JSON-LD posting is built from documents joined to part:
    the language of the document decides the shape (plain object, empty
    region + scalar employment type, @graph wrapper with zero salary, or no
    location/currency and a text organisation); small parts carry a list
    ``@type`` (not a match) or a null title (an unusable hit)."""
    d = T.spread(T.read_table(spark, sf, "documents"))
    p = T.read_table(spark, sf, "part")
    j = d.join(p, d.doc_id == p.p_partkey)
    lang, size = F.col("lang"), F.col("p_size")
    typ = F.when(size <= 3, F.to_json(F.array(F.lit("JobPosting")))).otherwise(_json_str(F.lit("JobPosting")))
    title = F.when(size.isin(4, 5), F.lit("null")).otherwise(_json_str(F.col("p_name")))
    region = F.when(lang == "fr", F.lit("")).otherwise(F.col("p_brand"))
    address = F.to_json(F.struct(F.col("lang").alias("addressLocality"), region.alias("addressRegion")))
    mn = F.when(lang == "de", F.lit(0)).otherwise(size * 1000)
    salary_val = F.when(lang == "es", F.to_json(F.struct(mn.alias("minValue"), (size * 1000 + 25000).alias("maxValue")))) \
        .otherwise(F.to_json(F.struct(mn.alias("minValue"), (size * 1000 + 25000).alias("maxValue"),
                                      F.lit("EUR").alias("currency"))))
    et = F.when(lang == "fr", _json_str(F.col("p_type"))).otherwise(F.to_json(F.array(F.col("p_type"))))
    name = F.when(size % 7 == 6, F.lit("")).otherwise(F.col("source"))  # some pages name no company
    org = F.when(lang == "es", _json_str(name)).otherwise(F.to_json(F.struct(name.alias("name"))))
    body = F.concat(
        F.lit('{"@type":'), typ, F.lit(',"title":'), title, F.lit(',"description":'), _json_str(F.col("text")),
        F.lit(',"hiringOrganization":'), org,
        F.when(lang == "es", F.lit("")).otherwise(F.concat(F.lit(',"jobLocation":{"address":'), address, F.lit("}"))),
        F.lit(',"baseSalary":{"value":'), salary_val, F.lit("}"),
        F.when(lang == "es", F.lit("")).otherwise(F.concat(F.lit(',"employmentType":'), et)),
        F.lit("}"))
    doc = F.when(lang == "de", F.concat(F.lit('{"@graph":[{"@type":"Organization"},'), body, F.lit("]}"))).otherwise(body)
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), doc,
                    F.lit("</script></head><body><p>"), F.col("text"), F.lit("</p></body></html>"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/jobs/"), F.col("doc_id").cast("string"))
    return j.select(F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html"))


@query("jsonld", ids=("I3", "H16", "H17", "H18", "T13", "T20"), sql="""
SELECT doc_id AS page_id,
       CASE WHEN p_size IN (4, 5) THEN 'error' ELSE 'ok' END AS jsonld_status,
       CASE WHEN p_size NOT IN (4, 5) THEN p_name END AS title,
       CASE WHEN p_size NOT IN (4, 5) THEN text END AS description,
       CASE WHEN p_size NOT IN (4, 5) THEN CASE WHEN p_size % 7 = 6 THEN '' ELSE source END END AS company,
       CASE WHEN p_size IN (4, 5) THEN NULL WHEN lang = 'es' THEN ''
            ELSE regexp_replace(concat(lang, ', ', CASE WHEN lang = 'fr' THEN '' ELSE p_brand END), '^[, ]+|[, ]+$', '', 'g') END AS location,
       CASE WHEN p_size IN (4, 5) OR lang = 'de' THEN NULL
            ELSE concat('$', format('{:,}', p_size * 1000), ' - $', format('{:,}', p_size * 1000 + 25000), ' ',
                        CASE WHEN lang = 'es' THEN 'USD' ELSE 'EUR' END) END AS salary,
       CASE WHEN p_size IN (4, 5) THEN NULL WHEN lang = 'es' THEN '' ELSE p_type END AS job_type
FROM documents JOIN part ON doc_id = p_partkey WHERE p_size > 3""")
def jsonld(spark, sf):
    return H.jsonld_postings(H.extract_pages(jsonld_pages(spark, sf)))


_ART = G.char_refs("regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '\\s*<[^>]*>\\s*', '', 'g')")
_TITLE = G.char_refs("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")
_FROM_URL = G.capitalize("CASE WHEN len(string_split(dom, '.')) >= 2 THEN split_part(dom, '.', 1) ELSE dom END")
_HEUR_SQL = f"""
hx AS (SELECT page_id, url, trim({_TITLE}) AS t, {_ART} AS art, replace(replace(replace(
              regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), 'careers.', ''), 'jobs.', '') AS dom
       FROM pages),
heur AS (SELECT page_id, url, CASE WHEN {G.valid_title('t')} THEN t END AS title, trim(art) AS description, {_FROM_URL} AS company,
                CAST(NULL AS VARCHAR) AS location,
                CASE WHEN NOT {G.valid_title('t')} THEN 'no_valid_title' WHEN length(trim(art)) < 100 THEN 'short_description' END AS reject_reason
         FROM hx)"""


@query("heuristics", ids=("I4", "T11", "T19", "B9", "B10", "B11", "H6"), sql="WITH " + _HEUR_SQL + " SELECT * FROM heur")
def heuristics(spark, sf):
    """On the given pages the article is the description and its heading the
    title; golden tests cover the other branches."""
    return H.heuristics(H.extract_pages(T.spread(T.read_table(spark, sf, "pages"))))


_JOB_FIELDS = ["title", "description", "company", "location", "salary", "job_type"]
_JL_SQL = """
jl AS (SELECT doc_id + 10000000000 AS page_id, concat('https://', source, '.example.com/jobs/', CAST(doc_id AS VARCHAR)) AS url,
       p_size, CASE WHEN p_size <= 3 THEN 'reject' WHEN p_size IN (4, 5) THEN 'error' ELSE 'jsonld' END AS parse_strategy,
       p_name AS title, text AS description, CASE WHEN p_size % 7 = 6 THEN '' ELSE source END AS company,
       CASE WHEN lang = 'es' THEN '' ELSE regexp_replace(concat(lang, ', ', CASE WHEN lang = 'fr' THEN '' ELSE p_brand END), '^[, ]+|[, ]+$', '', 'g') END AS location,
       CASE WHEN lang <> 'de' THEN concat('$', format('{:,}', p_size * 1000), ' - $', format('{:,}', p_size * 1000 + 25000), ' ',
                        CASE WHEN lang = 'es' THEN 'USD' ELSE 'EUR' END) END AS salary,
       CASE WHEN lang = 'es' THEN '' ELSE p_type END AS job_type
FROM documents JOIN part ON doc_id = p_partkey),
casc AS (
  SELECT page_id, url, parse_strategy, """ + ", ".join(f"CASE WHEN parse_strategy = 'jsonld' THEN {c} END AS {c}" for c in _JOB_FIELDS) + """,
         CASE parse_strategy WHEN 'error' THEN 'jsonld_unusable' WHEN 'reject' THEN 'no_valid_title' END AS reject_reason FROM jl
  UNION ALL
  SELECT page_id, url, CASE WHEN reject_reason IS NULL THEN 'heuristics' ELSE 'reject' END,
         """ + ", ".join(f"CASE WHEN reject_reason IS NULL THEN {c} END" for c in _JOB_FIELDS[:4]) + """, NULL, NULL, reject_reason FROM heur)"""


def _cascade_pages(spark, sf):
    pages = T.spread(T.read_table(spark, sf, "pages")).select("page_id", "url", "html")
    wrapped = jsonld_pages(spark, sf).select((F.col("page_id") + F.lit(10_000_000_000)).alias("page_id"), "url", "html")
    return pages.unionByName(wrapped)


@query("parse_cascade", ids=("I5", "I7", "T20", "L2"), sql="WITH " + _HEUR_SQL + "," + _JL_SQL + " SELECT * FROM casc")
def parse_cascade(spark, sf):
    """Pages plus JSON-LD pages through the whole cascade."""
    return H.parse_cascade(H.extract_pages(_cascade_pages(spark, sf)))


@query("store_postings", ids=("A4", "A5", "T8", "T9", "T10", "H2", "H3", "H19", "H20", "H21"),
       sql="WITH " + _HEUR_SQL + "," + _JL_SQL + f"""
SELECT concat(substr(sha256(url), 1, 16), '-0-{_EPOCH}') AS id, sha256(concat(url, title, c)) AS job_hash, title, c AS company,
       coalesce(description, '') AS description, coalesce(location, '') AS location, 0 AS remote, CAST(NULL AS INTEGER) AS salary_min,
       CAST(NULL AS INTEGER) AS salary_max, CAST(NULL AS VARCHAR) AS currency, coalesce(job_type, 'full-time') AS job_type,
       CAST(NULL AS VARCHAR) AS experience_level, 85 AS real_score, url AS source_url, 'career_page' AS source_platform,
       0 AS n_tags, TIMESTAMP '{AS_OF_CRAWL}' AS posted_at, TIMESTAMP '{AS_OF_CRAWL}' AS updated_at,
       TIMESTAMP '{AS_OF_CRAWL}' AS crawled_at, CAST(1 AS BIGINT) AS version
FROM (SELECT *, CASE WHEN company = '' THEN 'The Crawl' ELSE company END AS c FROM casc WHERE parse_strategy IN ('jsonld', 'heuristics'))""")
def store_postings(spark, sf):
    """Parsed postings in the row shape of the jobs table."""
    parsed = H.parse_cascade(H.extract_pages(_cascade_pages(spark, sf)))
    rows = H.normalise_postings(parsed, crawled_at=AS_OF_CRAWL, epoch=_EPOCH, company_name=F.lit("The Crawl"))
    return rows.withColumn("n_tags", F.size("tags")).drop("tags")


_VISIBLE = G.char_refs("regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>"
                       "|<footer.*?(</footer>|$)|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")


@query("page_text", ids=("I6", "H25", "H26"), sql=f"""
SELECT page_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split({_VISIBLE}, chr(10)),
         lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda p: p <> ''), chr(10)) AS text FROM pages""")
def page_text(spark, sf):
    """Visible text after dropping non-visible subtrees, cleaned."""
    return H.page_text(H.extract_pages(T.spread(T.read_table(spark, sf, "pages"))))


# ---------------------------------------------------------------- hashes over pages, raw-page rows, decode

_H1 = G.unescape("regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)")
_HOSTQ = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query("job_hash", ids=("H2", "T10"), sql=f"""
SELECT page_id, sha256(concat(url, {_H1}, {_HOSTQ})) AS job_hash,
       sha256(concat(url, '<nil>', {_HOSTQ})) AS job_hash_no_title FROM pages""")
def job_hash(spark, sf):
    p = T.read_table(spark, sf, "pages")
    title = S.html_unescape_basic(F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1))
    return p.select("page_id", S.job_hash("url", title, S.url_authority("url")).alias("job_hash"),
                    S.job_hash("url", F.lit(None).cast("string"), S.url_authority("url")).alias("job_hash_no_title"))


@query("short_hash", ids=("H3",), sql="""
SELECT page_id, substr(sha256(url), 1, 16) AS short_id,
       concat_ws('-', substr(sha256(url), 1, 16), '0', '1706659200') AS batch_id FROM pages""")
def short_hash(spark, sf):
    p = T.read_table(spark, sf, "pages")
    return p.select("page_id", S.short_hash("url").alias("short_id"),
                    S.batch_row_id("url", F.lit(0), F.lit(1706659200)).alias("batch_id"))


@query("raw_pages", ids=("A3", "A6", "A2", "H22"), sql=f"""
SELECT sha256(url) AS id, url, CAST(length(html) AS INTEGER) AS html_chars, TIMESTAMP '{AS_OF_CRAWL}' AS crawled_at,
       'success' AS status, CAST(NULL AS VARCHAR) AS error_message, strftime(TIMESTAMP '{AS_OF_CRAWL}', '%Y%m') AS crawl_ym
FROM pages""")
def raw_pages(spark, sf):
    from hirelake.operators.store import raw_page_rows
    rows = raw_page_rows(T.read_table(spark, sf, "pages"), AS_OF_CRAWL)
    return rows.select("id", "url", F.length("html").alias("html_chars"), "crawled_at", "status", "error_message",
                       "crawl_ym")


@query("decode_fetch", ids=("A16", "B17"), sql="""
SELECT page_id, 0 AS item_pos, url, CAST(length(html) AS INTEGER) AS html_chars, CAST(NULL AS VARCHAR) AS error,
       true AS success FROM pages
UNION ALL
SELECT page_id, 1, concat(url, '/jobs'), 0, 'HTTP 404', false FROM pages""")
def decode_fetch(spark, sf):
    p = T.read_table(spark, sf, "pages")
    item_ok = F.struct(F.col("url").alias("url"), F.col("html").alias("html"), F.lit(True).alias("success"))
    item_bad = F.struct(F.concat(F.col("url"), F.lit("/jobs")).alias("url"), F.lit("").alias("html"),
                        F.lit("HTTP 404").alias("error"), F.lit(False).alias("success"))
    bodies = p.select("page_id", F.concat(F.lit("["), F.to_json(item_ok), F.lit(","), F.to_json(item_bad),
                                          F.lit("]")).alias("body"))
    d = X.decode_fetch_response(bodies)
    return d.select("page_id", F.col("item_pos").cast("int").alias("item_pos"), "url",
                    F.length("html").alias("html_chars"), "error", "success")
