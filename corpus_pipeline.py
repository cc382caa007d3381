"""Documents to packed sequences: quality rules, near duplicates, repeated passages, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import public_path
from tidemark.llm.common import keyed, staged
from tidemark.llm.jaccard import jaccard_components
from tidemark.llm.packing import best_fit
from tidemark.llm.quality import quality_filter
from tidemark.llm.secrets import redact_live
from tidemark.llm.suffixes import strip_repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the ratio to the trusted documents keep."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("quality") == 1).select("doc_id")
    return quality_filter(docs, trusted)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of 0.8 similarity join: of the smallest doc_id, a missing one last.

    Rows are told apart by a key of their own, so a row without doc_id stays where it is the only one of its group, and of
    repeated rows one stays. Rows without words have no group and stay.
    """
    rows = keyed(docs)
    groups = jaccard_components(rows.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("key"), "component_id")
    ids = rows.select("key", F.col("doc.doc_id").cast("long").alias("id"))
    first = groups.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    return rows.join(first.select("first.key"), "key", "left_semi").select("doc.*")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that start more than once."""
    return strip_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced."""
    return redact_live(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequence and offset."""
    return best_fit(docs, public_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("passages", drop_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can express neither the hashed ratio nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
