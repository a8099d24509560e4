"""The operators of this folder as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigsift.llm import ann, bitslice, fingerprints, hardneg, jaccard, lines, mixing, oracle, packing, pii, quality, quotes, trie, urls
from sigsift.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
QUERIES = {}
ORACLE_SQL = oracle.STATEMENTS


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
    )


@query
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.written(F.col("sketch")).alias("fingerprint"),
        fingerprints.written(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "held_edited",
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ensemble = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = F.col("_score")
    return quality.scored(docs, ensemble).select(
        "_row.doc_id", quality.held_out(F.col("_row.doc_id")).alias("held_out"), score.alias("score"),
        F.when(score >= quality.ACCEPTED, 1).otherwise(0).alias("predicted"),
    )


@query
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=3, similarity=0.9)


URL_RULES = (
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
)


@query
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "documents"))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.allocate(table(spark, sf_dir, "documents"))
    first = F.get("_copies", F.lit(0))
    return planned.select(
        "_row.doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_taken").alias("taken"), F.round(first["position"], 6).alias("position"),
    )


@query
def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.threaded(table(spark, sf_dir, "conversations"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.built(table(spark, sf_dir, "conversations"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bitslice.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")
