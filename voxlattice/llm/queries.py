"""The queries of these operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlattice.llm import embedding_dedup, exact_dedup, html_extract, langid, mixing, ngram_join, packing, pii, token_counts, warc

#: The key of op4's surrogates; a deployment passes its own secret.
SURROGATE_KEY = "voxlattice"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_token_counts(_table(spark, sf_dir, "documents"), *token_counts.default_vocabulary())


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_texts(_table(spark, sf_dir, "documents"), pii.key_from(SURROGATE_KEY))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "whole")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_warc_transactions, op3_section_tokens, op4_pii_surrogates, op5_language_id, op6_source_mixing,
        op7_packing, op8_html_main_text, op9_embedding_near_dedup, op10_ngram_jaccard_join,
    )
}
