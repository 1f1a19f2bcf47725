"""Read chat and embedding requests from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.tags import valid_json
from parley.operators.requests import embedding_errors, input_texts, normalise_requests
from parley.schemas import EMBEDDING_REQUEST, RAW_REQUEST

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_json(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parse a text column; a line that is not exactly one such record keeps its text in ``_corrupt``."""
    parsed = lines.withColumn("_record", F.from_json(F.col(column), schema, _OPTIONS))
    open_end = ~F.coalesce(valid_json(F.col(column)), F.lit(False))
    return parsed.select(*[c for c in lines.columns if c != column], column, "_record.*").withColumn(
        "_corrupt", F.when(open_end, F.col(column)).otherwise(F.col("_corrupt"))
    ).drop(column)


def readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and rows for the quarantine table."""
    good: Column = F.col("_corrupt").isNull()
    return df.where(good).drop("_corrupt"), df.where(~good)


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Normalised chat requests of JSON-lines files, and what could not be read."""
    good, bad = readable(parse_json(spark.read.text(path), "value", RAW_REQUEST))
    return normalise_requests(good), bad


def read_embedding_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Embedding requests with ``input`` as a list, and what could not be read or has no usable input (with ``errors``)."""
    return embedding_requests(spark.read.text(path), "value")


def embedding_requests(lines: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The same for a text column; further columns stay."""
    kept = lines.withColumn("_line", F.col(column))
    good, unread = readable(parse_json(kept, column, EMBEDDING_REQUEST))
    good = good.withColumn("errors", embedding_errors(F.col("input")))
    typed = good.withColumn("input", input_texts(F.col("input")))
    unread = unread.withColumn("errors", F.array(F.lit("unreadable"))).withColumn("input", F.lit(None).cast("array<string>"))
    bad = typed.where(F.size("errors") > 0).unionByName(unread.drop("_corrupt"), allowMissingColumns=True)
    return typed.where(F.size("errors") == 0).drop("errors", "_line"), bad.withColumnRenamed("_line", "_corrupt")
