"""Fixed values that must equal the reference's for the same results.

FIXED VALUES — keyword lists, selector lists and the ATS rule table are kept
verbatim, in their natural order, because order changes results (first match
wins). Nothing here is logic; the functions that use them live beside this
module.
"""

# FIXED VALUES: phrases that disqualify a job title (substring, lower-cased)
BAD_TITLE_PHRASES = [
    "logo", "jobs", "career", "culture", "benefit", "principle", "your job",
    "find your", "we're hiring", "join", "everyone at", "you're not",
    "saved jobs", "dream job",
]

# FIXED VALUES: phrases that disqualify a company text
BAD_COMPANY_PHRASES = ["logo", "jobs", "career"]

# FIXED VALUES: place words that make a text look like a location (whole word)
LOCATION_WORDS = ["remote", "hybrid", "onsite", "usa", "uk", "ca", "us", "europe",
                  "americas", "asia"]

# FIXED VALUES: URL substrings of generic career pages that are never postings
SKIP_PATH_PATTERNS = [
    "/benefits", "/culture", "/life-at-", "/about", "/team", "/principles",
    "/values", "/diversity", "/inclusion", "/extraordinary", "/saved-jobs",
    "/all-jobs", "/accessibility", "/interview-process", "/disciplines",
    "/university",
]

# FIXED VALUES: URL substrings of posting detail pages
JOB_PATH_PATTERNS = [
    "/job/", "/jobs/", "/career/", "/careers/", "/position/", "/positions/",
    "/opening/", "/openings/", "/vacancy/", "/vacancies/", "/role/", "/roles/",
]

# FIXED VALUES: career-page keywords (subdomain/path candidates, content indicators)
CAREER_KEYWORDS = [
    "careers", "jobs", "hiring", "opportunities", "positions", "openings", "join",
    "work-with-us", "job-openings",
]

# FIXED VALUES: keywords that make a host name job related (DNS candidates too)
JOB_HOST_KEYWORDS = [
    "careers", "jobs", "hiring", "opportunities", "positions", "openings", "join",
    "work", "talent", "recruit",
]

# FIXED VALUES: ATS platforms in detection order:
# (platform, domain substrings, URL substrings, content indicators)
ATS_RULES = [
    ("greenhouse", ["greenhouse.io", "boards.greenhouse.io"], ["/jobs/"],
     ["greenhouse", "powered by greenhouse"]),
    ("ashby", ["jobs.ashbyhq.com"], ["/jobs/"], ["ashby", "ashbyhq"]),
    ("lever", ["jobs.lever.co"], ["/jobs/"], ["lever", "jobs.lever.co"]),
    ("workday", ["myworkdayjobs.com"], ["/jobs/"], ["workday", "myworkdayjobs"]),
    ("indeed", ["indeed.com"], ["/viewjob", "/cmp/", "/jobs"], ["indeed"]),
    ("linkedin", ["linkedin.com"], ["/jobs/view/", "/jobs/collections/"], ["linkedin jobs"]),
    ("bamboohr", ["bamboohr.com"], ["/jobs/"], ["bamboohr"]),
    ("icims", ["icims.com"], ["/jobs/"], ["icims"]),
]

# FIXED VALUES: ATS confidences (domain hit, URL-pattern hit, content hit, none)
ATS_CONF_DOMAIN = 0.95
ATS_CONF_PATH = 0.75
ATS_CONF_CONTENT = 0.6
ATS_CONF_NONE = 0.0

# FIXED VALUES: search-query templates for discovery (keyword-free and keyword forms)
QUERY_TEMPLATES_BASE = [
    'site:greenhouse.io OR site:lever.co OR site:ashbyhq.com "software engineer"',
    'inurl:careers OR inurl:jobs "we are hiring"',
    'intitle:"job openings" OR intitle:"careers" site:*.com',
    '"apply now" (inurl:jobs OR inurl:careers)',
]
QUERY_TEMPLATES_KEYWORD = [
    '"{kw}" (inurl:jobs OR inurl:careers)',
    'site:greenhouse.io "{kw}"',
]

# FIXED VALUES: heuristic selectors, in priority order.
# Each selector is (tag or None, attribute or None, operator, value):
#   operator "*=" is a case-sensitive substring of the attribute value,
#   "=" exact attribute value; tag None means any tag.
TITLE_SELECTORS = [
    ("h1", "class", "*=", "job"),
    ("h1", "class", "*=", "title"),
    ("h1", None, None, None),
    (None, "class", "*=", "job-title"),
    (None, "class", "*=", "position-title"),
]
COMPANY_SELECTORS = [
    (None, "class", "*=", "company-name"),
    (None, "class", "*=", "company"),
    (None, "class", "*=", "organization"),
    (None, "class", "*=", "employer"),
    ("meta", "property", "=", "og:site_name"),
]
LOCATION_SELECTORS = [
    (None, "class", "*=", "job-location"),
    (None, "class", "*=", "location"),
    (None, "data-test", "*=", "location"),
    (None, "class", "*=", "city"),
    (None, "class", "*=", "office"),
]
DESCRIPTION_SELECTORS = [
    (None, "class", "*=", "job-description"),
    (None, "class", "*=", "description"),
    (None, "class", "*=", "job-content"),
    (None, "class", "*=", "content"),
    ("main", None, None, None),
    ("article", None, None, None),
]

# FIXED VALUES: tags whose subtree is dropped before visible-text extraction
NON_VISIBLE_TAGS = ["script", "style", "nav", "header", "footer"]

# FIXED VALUES: defaults written by the posting normaliser
DEFAULT_JOB_TYPE = "full-time"
DEFAULT_REAL_SCORE = 85
DEFAULT_PLATFORM = "career_page"
DEFAULT_VERSION = 1
NIL_TEXT = "<nil>"

# FIXED VALUES: per-keyword search templates of the workflow side ({kw} = keyword)
KEYWORD_QUERY_TEMPLATES = [
    'intext:"{kw}" AND ("careers" OR "jobs")',
    'site:greenhouse.io "{kw}"',
    'site:lever.co "{kw}"',
    'site:ashbyhq.com "{kw}"',
    'inurl:careers "{kw}"',
    '"we are hiring" "{kw}"',
]

# FIXED VALUES: host enumeration methods in keep-first order
HOST_METHOD_ORDER = ["crt", "dns", "theharvester"]
