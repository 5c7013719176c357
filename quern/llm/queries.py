"""The corpus operators' queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, exact, language, lm, near, packing, quality, token_ids, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_lm(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is that of the document with its number: bad if of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_packing": op2_packing,
        "op3_quality": op3_quality,
        "op4_lm_score": op4_lm_score,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_language": op7_language,
        "op8_url_filter": op8_url_filter,
        "op9_warc": op9_warc,
        "op10_token_ids": op10_token_ids,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near.ORACLE_SQL,
        "op5_exact_dedup": exact.ORACLE_SQL,
        "op8_url_filter": urls.ORACLE_SQL,
        "op9_warc": warc.ORACLE_SQL,
    }
