"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import language_id, line_dedup, mixing, near_dedup, packing
from parley.llm.common import read, remainder, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Learning, retrieval and hashing have no SQL form.
ORACLE_SQL: str | None = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go. ``lang`` becomes the prediction."""
    labelled = docs.filter(remainder(F.col("doc_id"), 4) != 2).select("text", "lang")
    told = language_id.identify(docs, language_id.learn(labelled)).filter(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line once; documents of which nothing is left go. ``n_chars`` follows the text."""
    left = line_dedup.dedup_lines(docs).filter(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.survivors(near_dedup.near_duplicates(docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).filter(F.col("mix.copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs.select("doc_id", "text")).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
