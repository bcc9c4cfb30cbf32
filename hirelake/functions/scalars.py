"""Scalar Column functions (hashes, URLs, text, dates, small math).

All of these build JVM-side expressions; none calls back into Python, so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions import rules

ColOrName = Column | str


def _c(x: ColOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- hashes (H1-H3)

def url_hash(url: ColOrName) -> Column:
    """Lower-case hex sha256 of the URL (raw-page id, url_hash)."""
    return F.sha2(_c(url), 256)


def nil_text(x: ColOrName) -> Column:
    """How a missing value prints when formatted into a hash input."""
    return F.coalesce(_c(x).cast("string"), F.lit(rules.NIL_TEXT))


def job_hash(source_url: ColOrName, title: ColOrName, company: ColOrName) -> Column:
    """sha256 of url‖title‖company, no separator, NULL printed as ``<nil>``."""
    return F.sha2(F.concat(nil_text(source_url), nil_text(title), nil_text(company)), 256)


def short_hash(url: ColOrName) -> Column:
    """First 8 bytes (16 hex chars) of sha256(url)."""
    return F.substring(F.sha2(_c(url), 256), 1, 16)


def batch_row_id(url: ColOrName, index: ColOrName, epoch: ColOrName) -> Column:
    """``<short hash>-<index>-<epoch>`` id of one posting stored from a page."""
    return F.concat_ws("-", short_hash(url), _c(index).cast("string"), _c(epoch).cast("string"))


# ---------------------------------------------------------------- URLs (H4-H6)

_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_scheme(url: ColOrName) -> Column:
    return F.lower(F.regexp_extract(_c(url), _SCHEME_RE, 1))


def url_authority(url: ColOrName) -> Column:
    """netloc (host[:port], userinfo kept). Regex, so non-ASCII URLs work."""
    return F.regexp_extract(_c(url), _AUTH_RE, 1)


def url_host(url: ColOrName) -> Column:
    """Lower-cased host without userinfo and port."""
    auth = F.regexp_replace(url_authority(url), r"^.*@", "")
    return F.lower(F.regexp_replace(auth, r":[0-9]*$", ""))


def url_path(url: ColOrName) -> Column:
    return F.regexp_extract(_c(url), _PATH_RE, 1)


def path_segment_count(url: ColOrName) -> Column:
    """Segments of the path with all leading/trailing '/' stripped; '' counts 1."""
    p = F.regexp_replace(url_path(url), r"^/+|/+$", "")
    return F.size(F.split(p, "/"))


def is_http(url: ColOrName) -> Column:
    u = _c(url)
    return u.startswith("http://") | u.startswith("https://")


def _merged_path(base_path: Column, path: Column) -> Column:
    """Path of a relative reference: merged with the base's directory, empty
    inner segments dropped, dot segments resolved one after the other."""
    up = F.split(base_path, "/")
    directory = F.when(F.element_at(up, -1) != "", F.slice(up, 1, F.size(up) - 1)).otherwise(up)
    joined = F.concat(directory, F.split(path, "/"))
    n = F.size(joined)
    inner = F.filter(F.slice(joined, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    relative = F.when(n > 1, F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, -1, 1))).otherwise(joined)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(relative)
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    dots = F.element_at(segments, -1).isin(".", "..")
    out = F.array_join(F.when(dots, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def resolve_url(base: ColOrName, href: ColOrName) -> Column:
    """Absolute URL of ``href`` relative to page ``base``, as browsers' and
    the standard library's joins agree on: blanks and control characters in
    front are dropped, tabs and line ends vanish, query and fragment are cut
    off before dot segments are resolved (any number of them), a reference
    without a path keeps the base's, and one of another scheme stays as it
    is. An empty reference gives the base, an empty base the reference."""
    b, raw = _c(base), _c(href)
    h = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(b, _SCHEME_RE, 1))
    own = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(own != "", F.substr(h, F.length(own) + 2)).otherwise(h)
    network = rest.startswith("//")
    authority = F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    after = F.when(network, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest)
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    query = F.regexp_extract(after, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(after, r"(?s)^[^#]*#(.*)$", 1)
    base_path = url_path(b)
    base_query = F.regexp_extract(b, r"^[^?#]*\?([^#]*)", 1)
    tail_query = F.when((path == "") & (query == "") & ~network, base_query).otherwise(query)
    tail = F.concat(F.when(tail_query != "", F.concat(F.lit("?"), tail_query)).otherwise(F.lit("")),
                    F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    new_path = F.when(path == "", base_path).otherwise(_merged_path(base_path, path))
    return (F.when(raw == "", b).when(b == "", raw)
            .when((own != "") & (own != scheme), raw)
            .when(network, F.concat(scheme, F.lit(":"), F.regexp_extract(rest, r"^(//[^/?#]*)", 1), path, tail))
            .otherwise(F.concat(scheme, F.lit("://"), authority, new_path, tail)))


def capitalize(x: ColOrName) -> Column:
    """First character upper, the rest lower (not word-wise like initcap)."""
    s = _c(x)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substr(s, F.lit(2))))


def company_from_url(url: ColOrName) -> Column:
    """Company guess from a URL: netloc (or path when no netloc) with every
    ``www.``, ``careers.``, ``jobs.`` removed, first dot label, capitalised."""
    u = _c(url)
    netloc = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url_authority(u)).otherwise(F.lit(""))
    nopath = F.regexp_replace(u, r"[?#].*$", "")
    dom = F.when(netloc != "", netloc).otherwise(nopath)
    for prefix in ("www.", "careers.", "jobs."):
        dom = F.replace(dom, F.lit(prefix), F.lit(""))
    parts = F.split(dom, r"\.")
    first = F.when(F.size(parts) >= 2, F.get(parts, 0)).otherwise(dom)
    return capitalize(first)


# ---------------------------------------------------------------- text

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def strip_ws(x: ColOrName) -> Column:
    """Strip Unicode whitespace both ends (Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(x), rf"^{_WS}+|{_WS}+$", "")


def lower_trim(x: ColOrName) -> Column:
    return F.lower(strip_ws(x))


def contains_any(x: ColOrName, needles: list[str]) -> Column:
    arr = F.array(*[F.lit(n) for n in needles])
    return F.exists(arr, lambda k: F.contains(_c(x), k))


def mentions_any(x: ColOrName, needles: list[str]) -> Column:
    """``contains_any`` as one compiled pattern of quoted literals, for filters
    on plain columns. (Of nested expressions the optimiser derives not-null
    constraints from it, level by level, and planning a cascade takes minutes.)"""
    return _c(x).rlike("|".join(rf"\Q{n}\E" for n in needles))


def count_present(x: ColOrName, needles: list[str]) -> Column:
    """Number of distinct needles that occur in ``x``."""
    arr = F.array(*[F.lit(n) for n in dict.fromkeys(needles)])
    return F.size(F.filter(arr, lambda k: F.contains(_c(x), k)))


def clean_text(x: ColOrName, max_chars: int | None = None) -> Column:
    """Visible-text normalisation: split lines, strip, split on double space,
    strip, drop blanks, join with newline; with ``max_chars`` only so many
    characters."""
    lines = F.split(_c(x), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]")
    phrases = F.flatten(F.transform(lines, lambda l: F.split(strip_ws(l), "  ")))
    kept = F.filter(F.transform(phrases, lambda p: strip_ws(p)), lambda p: p != "")
    text = F.array_join(kept, "\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def html_unescape_basic(x: ColOrName) -> Column:
    """Decode the five XML entities (enough for attribute/text checks in SQL twins)."""
    s = _c(x)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(ent), F.lit(ch))
    return s


# ---------------------------------------------------------------- small math / dates

def keyword_confidence(n: ColOrName, base: float) -> Column:
    """``min(base + 0.1 n, 1.0)``, rounded to kill float noise."""
    return F.round(F.least(F.lit(1.0), F.lit(base) + F.lit(0.1) * _c(n)), 10)


def clock(as_of) -> Column:
    """A fixed wall-clock time as a naive timestamp (the tables' timestamps are
    naive too, so comparisons and outputs never depend on the session zone)."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    return clock(as_of) - F.make_dt_interval(F.lit(days))


def parse_rfc3339(x: ColOrName, fallback) -> Column:
    """RFC 3339 text to timestamp; missing/empty -> fallback; bad text -> epoch zero."""
    s = _c(x)
    short = F.regexp_replace(s, r"(\.[0-9]{6})[0-9]+", "$1")  # a timestamp holds microseconds
    parsed = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                        F.try_to_timestamp(short, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))).cast("timestamp_ntz")
    return (F.when(s.isNull() | (s == ""), clock(fallback).cast("timestamp_ntz"))
            .otherwise(F.coalesce(parsed, clock("0001-01-01 00:00:00"))))


def ts_text(x: ColOrName) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss")


def year_month(x: ColOrName) -> Column:
    return F.date_format(_c(x), "yyyyMM")


def fill_blank(x: ColOrName, default) -> Column:
    """NULL or '' -> default (explicit; never applied implicitly)."""
    d = F.lit(default) if not isinstance(default, Column) else default
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)
