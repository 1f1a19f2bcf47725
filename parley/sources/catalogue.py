"""The catalogue of served models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators.requests import model_id_of

# Owner of the embedding model and of chat models without a stated owner (fixed values).
EMBEDDING_OWNER = "sentence-transformers"
DEFAULT_OWNER = "second-state"


def plain_path(path: Column) -> Column:
    """A path without its scheme, so that a listed file and a configured one compare."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of the files below a folder, without reading them."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            plain_path(F.col("path")).alias("path"),
            F.unix_timestamp("modificationTime").alias("modified"),
        )
    )


def model_catalogue(configured: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue rows of (model_id, path, owned_by) and what else is configured; a missing file was created at 0."""
    return (
        configured.withColumn("path", plain_path(F.col("path")))
        .join(files, "path", "left")
        .select(
            *[c for c in configured.columns if c not in ("model_id", "path", "owned_by")],
            model_id_of(F.col("model_id"), F.col("path")).alias("id"),
            F.lit("model").alias("object"),
            F.coalesce("modified", F.lit(0)).cast("long").alias("created"),
            F.coalesce("owned_by", F.lit(DEFAULT_OWNER)).alias("owned_by"),
        )
    )
