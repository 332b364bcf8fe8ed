"""The queries ``opN_<name>`` of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fastaxis.llm import centroids, decontaminate, licences, line_dedup, ngram_join, oracle, packing, pii, quality, suffix_dedup, token_counts, toxicity, url_filter
from fastaxis.llm.common import documents


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, and their counts after a standard set of edits."""
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    made = token_counts.trees(documents(spark, sf_dir, "doc_id", "text"), ranks)
    return token_counts.edited(made, token_counts.standard_edits(F.col("text")), ranks).select("doc_id", "n_chars_before", "n_tokens_before", "n_chars_after", "n_tokens_after", "n_encoded")


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).drop("kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(documents(spark, sf_dir, "doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; the labelled URLs are the table's own, those whose host has an unwanted word against the others."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.labelled_by_words(pages, F.col("url"))).select("page_id", "host", "path", "rule", "verdict", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_licence_scan": op2_licence_scan,
    "op3_personal_data": op3_personal_data,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_line_templates": op6_line_templates,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_decontamination": op9_decontamination,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_url_filter": op12_url_filter,
}

ORACLE_SQL: dict[str, str] = oracle.SQL
