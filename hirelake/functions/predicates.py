"""Boolean Column predicates (B8-B20, B28) and the ATS classifier.

Each is a native expression; they are meant to be used inside ``filter`` /
``when`` of the bulk jobs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import rules
from hirelake.functions.scalars import (
    _c, contains_any, mentions_any, count_present, is_http, keyword_confidence, path_segment_count,
    url_authority,
)


def valid_title(x) -> Column:
    """3..150 chars, no banned phrase, and a run of 3 ASCII letters."""
    s = _c(x)
    n = F.length(s)
    return (F.coalesce(s != "", F.lit(False)) & n.between(3, 150)
            & ~contains_any(F.lower(s), rules.BAD_TITLE_PHRASES)
            & s.rlike("[a-zA-Z]{3,}"))


def valid_company(x) -> Column:
    """3..99 chars and none of logo/jobs/career."""
    s = _c(x)
    return (F.coalesce(s != "", F.lit(False)) & (F.length(s) > 2) & (F.length(s) < 100)
            & ~contains_any(F.lower(s), rules.BAD_COMPANY_PHRASES))


def valid_location(x) -> Column:
    """3..99 chars and a place word (whole word) or a comma."""
    s = _c(x)
    words = "|".join(rules.LOCATION_WORDS)
    return (F.coalesce(s != "", F.lit(False)) & (F.length(s) > 2) & (F.length(s) < 100)
            & (F.lower(s).rlike(rf"(?U)\b({words})\b") | F.contains(s, F.lit(","))))


def valid_description(x) -> Column:
    """Final description gate: at least 100 characters."""
    return F.coalesce(F.length(_c(x)) >= 100, F.lit(False))


def not_generic(url) -> Column:
    return ~mentions_any(F.lower(_c(url)), rules.SKIP_PATH_PATTERNS)


def is_job_url(url) -> Column:
    """Job-path pattern present and an id: any digit anywhere in the URL or
    at least 3 path segments."""
    u = _c(url)
    has_pattern = mentions_any(F.lower(u), rules.JOB_PATH_PATTERNS)
    has_id = u.rlike(r"\p{Nd}") | (path_segment_count(u) >= 3)  # a digit of any script
    return has_pattern & has_id


def link_title_ok(x) -> Column:
    s = _c(x)
    return F.coalesce(F.length(s).between(5, 200) & (s != ""), F.lit(False))


def same_host(a, b) -> Column:
    return url_authority(a) == url_authority(b)


def job_link_ok(page_url, abs_url, title) -> Column:
    """The whole link filter of one anchor (http, same host, not generic,
    job-like URL, title length)."""
    return (is_http(abs_url) & same_host(abs_url, page_url) & not_generic(abs_url)
            & is_job_url(abs_url) & link_title_ok(title))


def host_in_domain_suffix(host, domain) -> Column:
    """CT-log rule: host ends with the domain (no dot boundary)."""
    return _c(host).endswith(_c(domain))


def host_in_domain_contains(host, domain) -> Column:
    """Harvester rule: host contains the domain anywhere."""
    return F.contains(_c(host), _c(domain))


def job_related_host(host) -> Column:
    return contains_any(F.lower(_c(host)), rules.JOB_HOST_KEYWORDS)


def career_keyword_count(content) -> Column:
    return count_present(F.lower(_c(content)), rules.CAREER_KEYWORDS)


def fetch_ok(status) -> Column:
    return _c(status) < 400


# ---------------------------------------------------------------- ATS

def ats_from_url(url, domain_first: bool = False) -> Column:
    """Struct(is_ats, platform, confidence) from the URL alone, or NULL when no
    rule hits. Faithful order tests, per platform, its domains then its URL
    patterns (so a non-greenhouse URL with ``/jobs/`` is greenhouse @0.75);
    ``domain_first=True`` tests every platform's domains before any pattern."""
    u = F.lower(_c(url))
    chain = None

    def add(chain, cond, platform, conf):
        val = F.struct(F.lit(True).alias("is_ats"), F.lit(platform).alias("platform"),
                       F.lit(conf).alias("confidence"))
        return F.when(cond, val) if chain is None else chain.when(cond, val)

    if domain_first:
        for platform, domains, _, _ in rules.ATS_RULES:
            chain = add(chain, contains_any(u, domains), platform, rules.ATS_CONF_DOMAIN)
        for platform, _, patterns, _ in rules.ATS_RULES:
            chain = add(chain, contains_any(u, patterns), platform, rules.ATS_CONF_PATH)
    else:
        for platform, domains, patterns, _ in rules.ATS_RULES:
            chain = add(chain, contains_any(u, domains), platform, rules.ATS_CONF_DOMAIN)
            chain = add(chain, contains_any(u, patterns), platform, rules.ATS_CONF_PATH)
    return chain


def ats_from_content(content) -> Column:
    """Struct(is_ats, platform, confidence) from page content; none -> (false, NULL, 0.0)."""
    c = F.lower(_c(content))
    chain = None
    for platform, _, _, indicators in rules.ATS_RULES:
        val = F.struct(F.lit(True).alias("is_ats"), F.lit(platform).alias("platform"),
                       F.lit(rules.ATS_CONF_CONTENT).alias("confidence"))
        cond = contains_any(c, indicators)
        chain = F.when(cond, val) if chain is None else chain.when(cond, val)
    none = F.struct(F.lit(False).alias("is_ats"), F.lit(None).cast("string").alias("platform"),
                    F.lit(rules.ATS_CONF_NONE).alias("confidence"))
    return chain.otherwise(none)


def ats_classify(url, content=None, domain_first: bool = False) -> Column:
    """URL rules first; content rules only when no URL rule hit."""
    by_url = ats_from_url(url, domain_first)
    if content is None:
        none = F.struct(F.lit(False).alias("is_ats"), F.lit(None).cast("string").alias("platform"),
                        F.lit(rules.ATS_CONF_NONE).alias("confidence"))
        return F.coalesce(by_url, none)
    return F.coalesce(by_url, ats_from_content(content))


def host_priority(is_job_related) -> Column:
    """Host page scoring: job-related 0.8 / priority 1, else 0.5 / priority 2
    (priority 1 is best — kept as in the source, see README)."""
    j = _c(is_job_related)
    return F.struct(F.when(j, 0.8).otherwise(0.5).alias("confidence"),
                    F.when(j, 1).otherwise(2).alias("priority"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["keyword_confidence"]
