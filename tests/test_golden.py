"""Hand-written edge rows for the traps of the source (expected values
written from reading its code, not from running it)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hirelake.functions import predicates as P
from hirelake.functions import scalars as S
from hirelake.operators import aggregates as A
from hirelake.operators import discovery as X
from hirelake.operators import health as H
from hirelake.operators import html as HT
from hirelake.operators import upsert as U


def _one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col.alias("o")).collect()]


@pytest.mark.parametrize("url,content,platform,conf", [
    ("https://jobs.lever.co/x/jobs/1", None, "greenhouse", 0.75),
    ("https://jobs.lever.co/acme", None, "lever", 0.95),
    ("https://jobs.ashbyhq.com/acme", None, "ashby", 0.95),
    ("https://acme.test/jobs", None, "indeed", 0.75),
    ("https://www.linkedin.com/jobs/view/9", None, "greenhouse", 0.75),
    ("https://acme.test/about", "clever idea", "lever", 0.6),
    ("https://acme.test/about", "nothing here", None, 0.0),
])
def test_ats(spark, url, content, platform, conf):
    df = spark.createDataFrame([(url, content)], "u string, c string")
    r = df.select(P.ats_classify("u", F.col("c")).alias("a")).first()["a"]
    assert r["platform"] == platform and abs(r["confidence"] - conf) < 1e-9
    assert r["is_ats"] == (platform is not None)


def test_ats_domain_first(spark):
    df = spark.createDataFrame([("https://jobs.lever.co/x/jobs/1",)], "u string")
    r = df.select(P.ats_classify("u", None, domain_first=True).alias("a")).first()["a"]
    assert r["platform"] == "lever" and r["confidence"] == 0.95


def test_title_validity(spark):
    got = _one(spark, P.valid_title("x"), [("Go",), ("Careers",), ("123 456",), ("Data Engineer",)])
    assert got == [False, False, False, True]


def test_company_from_url(spark):
    assert _one(spark, S.company_from_url("x"), [("https://www.careers.ACME.co.uk/x",)]) == ["Acme"]


def test_job_hash_nil(spark):
    got = _one(spark, S.job_hash(F.lit("u"), F.lit(None).cast("string"), F.lit("c")), [("a",)])
    assert got == [hashlib.sha256(b"u<nil>c").hexdigest()]


def test_short_hash(spark):
    got = _one(spark, S.batch_row_id(F.col("x"), F.lit(0), F.lit(17)), [("https://a.test/p",)])
    assert got == [hashlib.sha256(b"https://a.test/p").hexdigest()[:16] + "-0-17"]


def test_confidence(spark):
    df = spark.createDataFrame([(2, 6)], "a int, b int")
    r = df.select(S.keyword_confidence("a", 0.5).alias("h"), S.keyword_confidence("b", 0.6).alias("p")).first()
    assert r["h"] == 0.7 and r["p"] == 1.0


def test_clean_text(spark):
    got = _one(spark, S.clean_text("x"), [("  a  b \n\n c\t\n",)])
    assert got == ["a\nb\nc"]


def test_element_text_stripped_join():
    r = HT.parse_page('<div class="description"><p>a </p><p>b</p></div>')
    assert r["description_cands"][1] == "ab"


def test_parser_stack_rules():
    html = ('<html><head><script>var t="</p>";</script><style>p{}</style></head><body>'
            '<nav><a href="/x">Nav</a></nav><article><h1>T &amp; U</h1><p><b>bold<p>more</article>'
            '<!-- c --><footer>f</footer></body></html>')
    r = HT.parse_page(html)
    assert r["title_cands"][2] == "T & U"
    assert r["description_cands"][5] == "T & Uboldmore"
    assert r["anchors"] == [{"pos": 0, "href": "/x", "text": "Nav"}]
    assert "Nav" not in r["visible_text"] and "f" not in r["visible_text"] and "var" not in r["visible_text"]


def _cascade(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r for r in HT.parse_cascade(HT.extract_pages(df)).collect()}


LD = '<script type="application/ld+json">{}</script>'


def test_jsonld_cases(spark):
    desc = "d" * 120
    pages = [
        (1, "https://a.test/1", LD.format('{"@type":"JobPosting","title":"T","description":"D",'
                                          '"baseSalary":{"value":{"minValue":120000,"maxValue":150000}},'
                                          '"employmentType":["FULL_TIME","X"],'
                                          '"jobLocation":{"address":{"addressLocality":"Berlin","addressRegion":""}}}')),
        (2, "https://a.test/2", LD.format('{"@type":["JobPosting"],"title":"T"}') + "<h1>Data Engineer</h1>"
         + f"<article>{desc}</article>"),
        (3, "https://a.test/3", LD.format("{bad json") + LD.format('{"@type":"JobPosting","title":"Second",'
                                                                   '"description":"x","employmentType":[]}')),
        (4, "https://a.test/4", LD.format('{"@type":"JobPosting","title":null}') + "<h1>Data Engineer</h1>"
         + f"<article>{desc}</article>"),
        (5, "https://a.test/5", LD.format('{"@type":"JobPosting","title":"T","jobLocation":[1],'
                                          '"baseSalary":{"value":{"minValue":0,"maxValue":5}}}')),
    ]
    r = _cascade(spark, pages)
    assert r[1]["parse_strategy"] == "jsonld" and r[1]["salary"] == "$120,000 - $150,000 USD"
    assert r[1]["location"] == "Berlin" and r[1]["job_type"] == "FULL_TIME" and r[1]["company"] == ""
    assert r[2]["parse_strategy"] == "heuristics" and r[2]["title"] == "Data Engineer"
    assert r[3]["parse_strategy"] == "jsonld" and r[3]["title"] == "Second" and r[3]["job_type"] == ""
    assert r[4]["parse_strategy"] == "error"
    assert r[5]["location"] is None and r[5]["salary"] is None and r[5]["job_type"] == ""


def test_heuristic_description_gate(spark):
    exact = "x" * 100
    pages = [(1, "https://www.acme.test/j", f"<h1>Data Engineer</h1><main>{exact}</main>"),
             (2, "https://acme.test/j", "<h1>Data Engineer</h1><main>short</main>"),
             (3, "https://acme.test/j", f"<h1>Go</h1><main>{exact}</main>")]
    r = _cascade(spark, pages)
    assert r[1]["parse_strategy"] == "heuristics" and r[1]["description"] == exact and r[1]["company"] == "Acme"
    assert r[2]["reject_reason"] == "short_description"
    assert r[3]["reject_reason"] == "no_valid_title"


def test_company_keeps_last_rejected(spark):
    body = "<h1>Data Engineer</h1>" + '<div class="company-name">Logo Inc</div>' + "<article>" + "y" * 150 + "</article>"
    r = _cascade(spark, [(1, "https://acme.test/j", body)])
    assert r[1]["company"] == "Logo Inc"


def test_job_links_rules(spark):
    p1 = ('<a href="/jobs/x1">bad</a><a href="/jobs/x1">Good Title</a>'
          '<a href="https://a1.test/jobs/x">Host Digit</a><a href="/about/jobs/7">About Page</a>'
          '<a href="https://other.test/jobs/9">Elsewhere</a>')
    p2 = '<a href="/jobs/listing">Listing Page</a><a href="/jobs/a/b">Three Segments</a>'
    df = spark.createDataFrame([(1, "https://a1.test/careers", p1), (2, "https://acme.test/careers", p2)],
                               "page_id long, url string, html string")
    links = {r["url"]: r["title"] for r in HT.job_links(HT.extract_pages(df)).collect()}
    assert links == {"https://a1.test/jobs/x1": "Good Title", "https://a1.test/jobs/x": "Host Digit",
                     "https://acme.test/jobs/a/b": "Three Segments"}


def test_resolve_url(spark):
    df = spark.createDataFrame([("http://h.test/a/b?q=1#f", "../c"), ("http://h.test/a/b", "//o.test/x"),
                                ("http://h.test/a/b", "?z"), ("http://h.test/a/b#f", "")], "b string, h string")
    got = [r[0] for r in df.select(S.resolve_url("b", "h")).collect()]
    assert got == ["http://h.test/c", "http://o.test/x", "http://h.test/a/b?z", "http://h.test/a/b#f"]


def test_url_upsert(spark):
    old = spark.createDataFrame([("h", 0.5, 2, "first", 1)], "url_hash string, confidence double, priority int, page_type string, seq int")
    new = spark.createDataFrame([("h", 0.8, 1, "second", 2)], old.schema)
    r = U.upsert_urls(old, new).first()
    assert (r["confidence"], r["priority"], r["page_type"]) == (0.8, 2, "first")


def test_company_upsert_empty_overwrites(spark):
    schema = "domain string, id int, name string, description string, source string, seq int"
    old = spark.createDataFrame([("a.test", 1, "A", "old", "github", 1)], schema)
    new = spark.createDataFrame([("a.test", 2, "A2", "", "manual", 2), ("a.test", 3, "A3", None, "manual", 3)], schema)
    r = U.upsert_companies(old, new).first()
    assert (r["id"], r["name"], r["description"], r["source"]) == (1, "A3", "", "github")


def test_job_type_default(spark):
    parsed = spark.createDataFrame([(1, "u1", "jsonld", "T", "D", "C", None, None, None),
                                    (2, "u2", "jsonld", "T", "D", "C", None, None, "")],
                                   "page_id long, url string, parse_strategy string, title string, description string, "
                                   "company string, location string, salary string, job_type string")
    rows = {r["source_url"]: r["job_type"] for r in HT.normalise_postings(parsed).collect()}
    assert rows == {"u1": "full-time", "u2": ""}


def test_health_fold(spark):
    seq = ["F", "F", "S", "F", "F", "F"]
    ev = spark.createDataFrame([(1, i, s) for i, s in enumerate(seq)], "k long, t long, s string")
    r = H.health_fold(ev, "k", ["t"], F.col("s") == "S", F.col("s") == "F").first()
    assert (r["fail_count"], r["success_count"], r["is_healthy"]) == (3, 1, False)


def test_ct_hosts(spark):
    e = spark.createDataFrame([("a.test", "*.a.test\n www.a.test")], "domain string, name_value string")
    got = sorted(r["subdomain"] for r in X.ct_hosts(e).collect())
    assert got == ["a.test", "www.a.test"]


def test_batch_totals(spark):
    b = spark.createDataFrame([(True, 0, 0), (False, 3, 1)], "batch_error boolean, ok int, failed int")
    r = A.batch_totals(b).first()
    assert (r["successful"], r["failed"], r["total_crawled"]) == (3, 2, 5)


def test_jsonld_text_only_fields(spark):
    pages = [
        (1, "https://a.test/1", LD.format('{"@type":"JobPosting","title":"T","description":"D",'
                                          '"hiringOrganization":{"name":42}}')),
        (2, "https://a.test/2", LD.format('{"@type":"JobPosting","title":"T","description":"D","employmentType":7}')),
        (3, "https://a.test/3", LD.format('{"@type":"JobPosting","title":"T","description":"D",'
                                          '"hiringOrganization":42,"employmentType":[null],'
                                          '"jobLocation":{"address":"x","name":"Berlin"}}')),
        (4, "https://a.test/4", LD.format('{"@type":"JobPosting","title":"T","description":"D",'
                                          '"hiringOrganization":null,"employmentType":null}')),
    ]
    r = _cascade(spark, pages)
    assert r[1]["parse_strategy"] == "error" and r[2]["parse_strategy"] == "error"
    assert r[3]["parse_strategy"] == "jsonld" and r[3]["company"] == "42" and r[3]["location"] == "Berlin"
    assert r[3]["job_type"] is None
    assert r[4]["parse_strategy"] == "jsonld" and r[4]["company"] == "None" and r[4]["job_type"] is None
