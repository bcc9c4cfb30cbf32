"""Queries: index + search page, facets, hydrate, fuzzy and prefix terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators import search as R
from hirelake.operators.joins import hydrate
from hirelake.plans.registry import query
from hirelake.sources import tables as T
from hirelake.sources.tables import POSTINGS_SQL, with_sql

Q_TEXT = "the river of ment tion"
FIELDS = {"title": "title", "company": "source", "description": "text"}


#: MB of the documents' files in a task that counts their tokens: the counts fit in its memory
TASK_MB = 8


def _docs(spark, sf, mb=None):
    d = T.spread(T.read_table(spark, sf, "documents"), mb)
    return d.select("doc_id", "lang", "source", "n_chars", "text",
                    F.get(F.split("text", "\n"), 0).alias("title"))


def _built(spark, sf):
    return R.build_index(_docs(spark, sf, TASK_MB), FIELDS)


def _index(spark, sf):
    """The index of the documents, written by token prefix once for each
    state of the table; the searches read the folders of their tokens."""
    return R.standing_index(spark, f"{sf.rstrip('/')}/documents.parquet", FIELDS, lambda: _built(spark, sf))


def _words(spark, sf):
    """The index's distinct words, stored beside it."""
    return R.standing_words(spark, _index(spark, sf), f"{sf.rstrip('/')}/documents.parquet", FIELDS)


def _hits(spark, sf):
    return R.search_hits(_index(spark, sf), Q_TEXT)


_TOK = "regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+')"
_QT = "('" + "','".join(R.query_tokens(Q_TEXT)) + "')"
_HITS_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, n_chars, text, string_split(text, chr(10))[1] AS title FROM documents),
p AS (
  SELECT doc_id, unnest({_TOK.format(c='title')}) AS token, 3 AS weight FROM d
  UNION ALL SELECT doc_id, unnest({_TOK.format(c='source')}), 2 FROM d
  UNION ALL SELECT doc_id, unnest({_TOK.format(c='text')}), 1 FROM d),
hits AS (SELECT doc_id, count(DISTINCT token) AS matched, max(weight) AS best_weight, CAST(count(*) AS BIGINT) AS total_tf
         FROM p WHERE token IN {_QT} GROUP BY doc_id)
"""


@query("search", ids=("J1", "J2", "F6", "F7"), sql=_HITS_SQL + """
SELECT doc_id, matched, best_weight, total_tf, (SELECT count(*) FROM hits) AS found FROM hits
ORDER BY matched DESC, best_weight DESC, total_tf DESC, doc_id LIMIT 20""")
def search(spark, sf):
    return R.search_page(_hits(spark, sf), 1, 20)


@query("search_page2", ids=("F6",), sql=_HITS_SQL + """
SELECT doc_id, matched, best_weight, total_tf, (SELECT count(*) FROM hits) AS found FROM hits
ORDER BY matched DESC, best_weight DESC, total_tf DESC, doc_id LIMIT 10 OFFSET 10""")
def search_page2(spark, sf):
    return R.search_page(_hits(spark, sf), 2, 10)


FACETS = ["company", "location", "remote", "currency", "job_type", "experience_level", "source_platform", "tags"]
JOB_QUERY = "building machinery"


@query("facets", ids=("D6", "J5"), sql=with_sql(POSTINGS_SQL) + """
, hit AS (SELECT * FROM jobs WHERE company IN ('BUILDING', 'MACHINERY'))
""" + " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM hit WHERE {f} IS NOT NULL GROUP BY ALL"
                         for f in FACETS[:-1]) + """
UNION ALL SELECT 'tags', t, count(*) FROM (SELECT unnest([lower(company), lower(location)]) AS t FROM hit) GROUP BY ALL""")
def facets(spark, sf):
    jobs = T.postings(spark, sf)
    index = R.build_index(jobs, {"title": "title", "company": "company"}, id_col="id", only_tokens=R.query_tokens(JOB_QUERY))
    hits = R.search_hits(index, JOB_QUERY).select(F.col("doc_id").alias("id"))
    return R.facet_counts(jobs.join(hits, "id"), FACETS)


@query("hydrate", ids=("C9",), sql=_HITS_SQL + """
, top AS (SELECT * FROM hits ORDER BY matched DESC, best_weight DESC, total_tf DESC, doc_id LIMIT 20)
SELECT t.doc_id, t.matched, d.lang, d.source, d.n_chars FROM top t JOIN d USING (doc_id)""")
def hydrate_hits(spark, sf):
    page = _hits(spark, sf).orderBy(*R.rank_order()).limit(20).select("doc_id", "matched")
    return hydrate(page, _docs(spark, sf).select("doc_id", "lang", "source", "n_chars"), "doc_id")


FUZZY_TERMS = ["thinng", "oering", "erandd", "thattion"]
PREFIXES = ["thing", "ment", "oner", "zuei"]
_VOCAB_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10))[1] AS title FROM documents),
p AS (
  SELECT doc_id, unnest({_TOK.format(c='title')}) AS token, 3 AS weight FROM d
  UNION ALL SELECT doc_id, unnest({_TOK.format(c='source')}), 2 FROM d
  UNION ALL SELECT doc_id, unnest({_TOK.format(c='text')}), 1 FROM d),
v AS (SELECT DISTINCT token AS word FROM p WHERE token <> ''),
fz AS (SELECT term, word, CAST(levenshtein(word, term) AS INTEGER) AS distance
       FROM v JOIN (SELECT unnest(['""" + "','".join(FUZZY_TERMS) + """']) AS term) ON abs(length(word) - length(term)) <= 1
       WHERE levenshtein(word, term) <= 1),
px AS (SELECT prefix, word FROM v JOIN (SELECT unnest(['""" + "','".join(PREFIXES) + """']) AS prefix) ON starts_with(word, prefix))
"""


@query("fuzzy", ids=("J3",), sql=_VOCAB_SQL + "SELECT * FROM fz")
def fuzzy(spark, sf):
    return R.fuzzy_terms(_words(spark, sf), FUZZY_TERMS, 1)


@query("prefix", ids=("J4",), sql=_VOCAB_SQL + "SELECT * FROM px")
def prefix(spark, sf):
    return R.prefix_terms(_words(spark, sf), PREFIXES)


@query("search_fuzzy", ids=("J2", "J3", "J4"), sql=_VOCAB_SQL + """
, x AS (SELECT term, word FROM fz UNION SELECT prefix, word FROM px),
pt AS (SELECT doc_id, term, max(weight) AS w, count(*) AS tf FROM p JOIN x ON p.token = x.word GROUP BY ALL)
SELECT doc_id, count(*) AS matched, max(w) AS best_weight, CAST(sum(tf) AS BIGINT) AS total_tf FROM pt GROUP BY doc_id""")
def search_fuzzy(spark, sf):
    index = _index(spark, sf)
    vocab = _words(spark, sf)
    terms = R.fuzzy_terms(vocab, FUZZY_TERMS, 1).select("term", "word").unionByName(
        R.prefix_terms(vocab, PREFIXES).select(F.col("prefix").alias("term"), "word"))
    return R.search_expanded(index, terms)
