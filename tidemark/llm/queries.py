"""Queries of the training-data operators over their whole tables, and their SQL where it can be stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_documents, public_path
from tidemark.llm.common import documents
from tidemark.llm.html import main_text
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.media import decode_media, media_digests, store_texts
from tidemark.llm.oracles import ORACLES
from tidemark.llm.packing import best_fit
from tidemark.llm.pii import personal_data
from tidemark.llm.quality import quality_rules
from tidemark.llm.secrets import secret_scan
from tidemark.llm.suffixes import remove_repeats
from tidemark.llm.toxicity import toxicity


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(decode_media(store_texts(documents(spark, sf_dir))))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir), public_path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), public_path("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality") == 1).select("doc_id")
    return quality_rules(documents(spark, sf_dir), trusted)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_media, op2_suffixes, op3_packing, op4_secrets, op5_jaccard, op6_bpe, op7_pii, op8_toxicity, op9_quality, op10_html)}
