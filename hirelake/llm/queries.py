"""The registered queries of the training-data operators: each applies its
operator to a whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.simhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hirelake.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hirelake.llm.token_files import read_token_files, write_token_files
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path, end_id=1))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.decontaminate import find_contamination
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.rules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.quality import classifier, held_out, quality_scores
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, classifier(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.pii import BASE, find_pii, listed, of_kind
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.size(of_kind(F.col("base"), i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.html_text import extract_text
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from hirelake.llm.pieces import encode
    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode(table(spark, sf_dir, "documents"), path).select("doc_id", "n_tokens", "ids_crc32", "round_trip")


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.suffix_dedup import remove_repeats
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.whitening import whiten
    found = whiten(table(spark, sf_dir, "embeddings"), components=16)
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error",
                        F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.collocations import collocations
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000).drop("cut")


@query
def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hirelake.llm.lm_score import lm_scores
    return lm_scores(table(spark, sf_dir, "documents"), order=3, modulus=10)
