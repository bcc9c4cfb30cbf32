"""Search and facets as DataFrame jobs.

The index is a postings table ``(token, doc_id, field, tf)``. A query is a
handful of tokens — bounded by the query text, so it is broadcast — joined
to the postings, then one aggregate per document ranks the hits with a
stated, deterministic order: matched query tokens, best field weight, total
term frequency, then id. Typo and prefix matching run on the *distinct
vocabulary*, never on documents, through equi-joins on a length or prefix
bucket (no cross join).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.operators import stored
from hirelake.session import materialised, settings, shared_dir
from hirelake.sources.tables import parts

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# FIXED VALUES: field priority of the posting search (higher wins)
FIELD_WEIGHTS = {"title": 3, "company": 2, "description": 1}


def tokens(col) -> Column:
    """Lower-cased word tokens of a text column (letters and digits)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def query_tokens(q: str) -> list[str]:
    """Tokens of a query string; an empty query is an error (as in the source)."""
    toks = [t for t in re.split(r"[\W_]+", (q or "").lower()) if t]
    if not toks:
        raise ValueError("empty search query")
    return list(dict.fromkeys(toks))


def _token_rows(docs: DataFrame, fields: dict[str, str], id_col: str) -> DataFrame:
    """One row per (doc, token occurrence, field) from a single scan: the
    fields become rows, then their tokens; no function runs inside an array,
    so all of it is compiled. ``which`` is the field's place in ``fields``."""
    texts = [F.struct(F.lit(i).alias("which"), F.col(col).cast("string").alias("text")) for i, col in enumerate(fields.values())]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(*texts)))
    words = rows.select("doc_id", "which", F.explode(F.split(F.lower("text"), TOKEN_SPLIT)).alias("token"))
    return words.filter(F.col("token") != "")


def build_index(docs: DataFrame, fields: dict[str, str], id_col: str = "doc_id",
                only_tokens: list[str] | None = None) -> DataFrame:
    """Postings ``(token, doc_id, field, weight, tf)`` over the given
    fields, from one scan of the documents. With ``only_tokens`` the rows are
    filtered right after the split, so a query never materialises the whole
    index. Rows are counted under the field's number; its name comes after."""
    t = _token_rows(docs, fields, id_col)
    if only_tokens is not None:
        t = t.filter(F.col("token").isin(only_tokens))
    n = t.groupBy("token", "doc_id", "which").agg(F.count(F.lit(1)).alias("tf"))
    names, weights = F.array(*map(F.lit, fields)), F.array(*[F.lit(FIELD_WEIGHTS.get(f, 1)) for f in fields])
    return n.select("token", "doc_id", F.get(names, "which").alias("field"), F.get(weights, "which").alias("weight"), "tf")


#: one character: few folders; files are sorted by token, so their statistics narrow a read further
PREFIX_LEN = 1


#: files that a task keeps open at once; with them Spark needs no sort by prefix of its own
OPEN_FILES = 32


def write_index(index: DataFrame, path: str, prefix_len: int = PREFIX_LEN, partitions: int | None = None) -> None:
    """Persist the postings partitioned by token prefix, so a query reads only
    the prefixes of its tokens (partition pruning). Range-partitioned on
    (token, doc), which is by prefix, too: a very common prefix is written by many
    tasks, and files hold a range of tokens for min/max skipping. Inside a file the
    order is by the token's first seven bytes as a number, which Spark sorts
    without comparing rows: most rows of a common token tie."""
    spark = index.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        first = F.rpad(F.hex(F.substring(F.col("token").cast("binary"), 1, 7)), 14, "0")
        (index.repartitionByRange(n, "token", "doc_id")
         .withColumn("__first", F.conv(first, 16, 10).cast("long")).sortWithinPartitions("__first").drop("__first")
         .withColumn("prefix", F.substring("token", 1, prefix_len))
         .write.mode("overwrite").partitionBy("prefix").parquet(path))


#: MB of source files to a partition of the index, so that a task's share does not grow with the source
PART_MB = 8


def _standing(spark: SparkSession, source: str, fields: dict[str, str], folder: str | None) -> tuple[str, int]:
    """The folder of the index of the files under ``source``, named after their
    names, sizes and times and after the fields, and the number of its parts."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    files, state = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True), []
    while files.hasNext():
        f = files.next()
        state.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    name = hashlib.sha256(repr((sorted(state), sorted(fields.items()), PREFIX_LEN)).encode()).hexdigest()[:16]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return f"{(folder or shared_dir(spark)).rstrip('/')}/index-{name}", parts(sum(s[1] for s in state), PART_MB, least)


def standing_index(spark: SparkSession, source: str, fields: dict[str, str], build: Callable[[], DataFrame],
                   folder: str | None = None) -> DataFrame:
    """The index of the files under ``source``, built once for each state of
    them and closed by a marker when it is written. Every later search, also
    of another query, reads it. The shuffles of the build have as many partitions
    as the files' size asks for. ``folder`` keeps indexes beyond the application."""
    path, n = _standing(spark, source, fields, folder)
    if not stored.is_closed(spark, path):
        with settings(spark, {"spark.sql.shuffle.partitions": str(n)}):
            write_index(build(), path)
        stored.close(spark, path)
    return spark.read.parquet(path)


def standing_words(spark: SparkSession, index: DataFrame, source: str, fields: dict[str, str],
                   folder: str | None = None) -> DataFrame:
    """``(word, prefix)``, the distinct words of the standing index,
    written once beside it by the same prefixes and sorted, so that a
    look-up reads words and no postings."""
    path, n = _standing(spark, source, fields, folder)
    path = f"{path}-words"
    if not stored.is_closed(spark, path):
        with settings(spark, {"spark.sql.shuffle.partitions": str(n)}):
            words = vocabulary(index).withColumn("prefix", F.substring("word", 1, PREFIX_LEN))
            # without a number of partitions: Spark joins small ones, words are far fewer than postings
            (words.repartitionByRange("prefix", "word").sortWithinPartitions("prefix", "word")
             .write.mode("overwrite").partitionBy("prefix").parquet(path))
        stored.close(spark, path)
    return spark.read.parquet(path)


def search_hits(index: DataFrame, q: str) -> DataFrame:
    """Every matching document with its ranking features: matched query
    tokens, best field weight, total term frequency. Two small aggregates
    (per document and token, then per document) instead of a distinct count."""
    qt = query_tokens(q)
    if "prefix" in index.columns:  # a persisted index: read only the query's prefix folders
        index = index.filter(F.col("prefix").isin(sorted({t[:PREFIX_LEN] for t in qt})))
    per_token = (index.filter(F.col("token").isin(qt)).groupBy("doc_id", "token")
                 .agg(F.max("weight").alias("w"), F.sum("tf").alias("tf")))
    return per_token.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.max("w").alias("best_weight"),
                                           F.sum("tf").cast("long").alias("total_tf"))


def rank_order() -> list:
    return [F.col("matched").desc(), F.col("best_weight").desc(), F.col("total_tf").desc(), F.col("doc_id").asc()]


def search_expanded(index: DataFrame, terms: DataFrame) -> DataFrame:
    """J2 over expanded terms (J3, J4): ``terms`` is ``(term, word)`` with the
    vocabulary words that stand for each query term. An equi-join on the word,
    so a term may stand for any number of words; ``matched`` counts terms. The
    terms are written first: the planner then knows their size, and a
    persisted index is read in the folders of their words only."""
    t = materialised(terms.select("term", F.col("word").alias("token")).distinct(), "terms")
    if "prefix" in index.columns:  # first characters: no more than the alphabet has
        first = t.select(F.substring("token", 1, PREFIX_LEN).alias("p")).distinct()
        index = index.filter(F.col("prefix").isin([r.p for r in first.collect()]))
    per_term = index.join(t, "token").groupBy("doc_id", "term").agg(F.max("weight").alias("w"), F.sum("tf").alias("tf"))
    return per_term.groupBy("doc_id").agg(F.count(F.lit(1)).alias("matched"), F.max("w").alias("best_weight"),
                                          F.sum("tf").cast("long").alias("total_tf"))


def search_page(hits: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """one page of ranked hits plus the total ``found`` count, both from
    one run of the search."""
    hits = materialised(hits, "hits")
    found = hits.agg(F.count(F.lit(1))).scalar()
    ranked = hits.orderBy(*rank_order()).offset((page - 1) * per_page).limit(per_page)
    return ranked.withColumn("found", found)


def _facet_values(hits_with_fields: DataFrame, facets: list[str]) -> DataFrame:
    """``(facet, value)``, a row for each value a hit has in each field."""
    def values(f):
        many = isinstance(hits_with_fields.schema[f].dataType, T.ArrayType)
        return F.transform(F.col(f) if many else F.array(F.col(f)), lambda v: F.struct(
            F.lit(f).alias("facet"), v.cast("string").alias("value")))

    return hits_with_fields.select(F.inline(F.concat(*map(values, facets)))).filter(F.col("value").isNotNull())


def facet_counts(hits_with_fields: DataFrame, facets: list[str]) -> DataFrame:
    """Counts per value of each facet field over the hits, in one scan
    and one aggregate; a list field counts each of its values, a field
    without a value counts nowhere."""
    return _facet_values(hits_with_fields, facets).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def facets_top(hits_with_fields: DataFrame, facets: list[str], k: int, tracked: int = 4096) -> DataFrame:
    """D6 with ``k`` values a facet: ``(facet, rank, value, n)``, the most
    frequent values with exact counts, ties by value.

    A facet with millions of values does not need them all counted. One
    sketch per facet (``approx_top_k``, of bounded size) names candidates; only
    they are counted exactly, in map-side aggregates. A value that the sketch
    does not name occurs at most ``bound`` times: twice the sketch's error, or the
    estimate of the last value named if its list is full. If the k-th exact
    count is above that, no other value can belong among the ``k``. Facets where
    that is not sure (many ties at the cut) are counted in full."""
    spark = hits_with_fields.sparkSession
    long = _facet_values(hits_with_fields, facets)
    named = tracked // 4
    sketch = long.groupBy("facet").agg(F.count(F.lit(1)).alias("total"),
                                       F.expr(f"approx_top_k(value, {named}, {tracked})").alias("top"))
    found = {r.facet: r for r in sketch.collect()}  # at most ``named`` values for each facet asked for
    if not found:
        return spark.createDataFrame([], "facet string, rank int, value string, n long")
    cands = [(f, t["item"]) for f, r in found.items() for t in r.top]
    cand_rows = F.broadcast(spark.createDataFrame(cands, "facet string, value string"))
    exact = materialised(long.join(cand_rows, ["facet", "value"]).groupBy("facet", "value").agg(
        F.count(F.lit(1)).alias("n")), "facets")
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    best = exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)  # at most ``named`` rows a facet
    cut = {r.facet: (r.c, r.n) for r in best.groupBy("facet").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect()}

    def sure(f):
        top, (c, least) = found[f].top, cut.get(f, (0, 0))
        if len(top) < named and found[f].total == sum(t["count"] for t in top):
            return True  # every value is named
        bound = max(2 * 3.5 / tracked * found[f].total, top[-1]["count"] if len(top) == named else 0)
        return c == k and least > bound

    unsure = [f for f in found if not sure(f)]
    out = best.filter(~F.col("facet").isin(unsure)) if unsure else best
    if unsure:
        full = facet_counts(hits_with_fields, unsure)
        share = F.pmod(F.xxhash64("value"), F.lit(64))  # a facet's values never meet in one task whole
        near = full.withColumn("__r", F.row_number().over(Window.partitionBy("facet", share).orderBy(F.desc("n"), "value")))
        near = near.filter(F.col("__r") <= k).drop("__r")
        out = out.unionByName(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    return out.select("facet", "rank", "value", "n")


def vocabulary(index: DataFrame) -> DataFrame:
    """The distinct words of an index."""
    return index.select(F.col("token").alias("word")).distinct()


def fuzzy_terms(vocab: DataFrame, terms: list[str], max_edits: int = 2) -> DataFrame:
    """Vocabulary words within ``max_edits`` edits of each term. Candidate
    pairs come from an equi-join on word length (|len diff| <= max_edits)."""
    spark = vocab.sparkSession
    rows = [(t, len(t) + d) for t in dict.fromkeys(terms) for d in range(-max_edits, max_edits + 1)]
    q = F.broadcast(spark.createDataFrame(rows, "term string, wlen int"))
    v = vocab.withColumn("wlen", F.length("word"))
    j = v.join(q, "wlen")
    d = F.levenshtein("word", "term", max_edits)
    return j.select("term", "word", d.alias("distance")).filter(F.col("distance") >= 0)


def prefix_terms(vocab: DataFrame, prefixes: list[str], bucket: int = 1) -> DataFrame:
    """Vocabulary words starting with each prefix, via an equi-join on the
    first ``bucket`` characters. Stored words are read in the folders of the
    prefixes only."""
    spark = vocab.sparkSession
    if "prefix" in vocab.columns:
        vocab = vocab.filter(F.col("prefix").isin(sorted({p[:PREFIX_LEN] for p in prefixes if p}))).drop("prefix")
    q = F.broadcast(spark.createDataFrame([(p, p[:bucket]) for p in dict.fromkeys(prefixes) if p],
                                          "prefix string, b string"))
    v = vocab.withColumn("b", F.substring("word", 1, bucket))
    return v.join(q, "b").filter(F.col("word").startswith(F.col("prefix"))).select("prefix", "word")
