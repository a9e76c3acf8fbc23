"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiermeter.llm import binary_output, divergence, language_model, line_dedup, media, mixing, ngram_join, packing, pii, quality, rules, tokens, vector_codes
from tiermeter.llm.common import documents, tune


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogates(documents(spark, sf_dir))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model(documents(spark, sf_dir))


def op8_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.write_rows(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.judge(docs, rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(tune(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media, op2_ngram_join, op3_packing, op4_token_counts, op5_quality, op6_surrogates, op7_language_model, op8_token_rows, op9_mixing, op10_quality_rules,
        op11_divergence, op12_vector_codes, op13_line_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.ORACLE, "op11_divergence": divergence.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
