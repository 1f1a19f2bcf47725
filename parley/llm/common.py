"""Helpers that several of these operators share."""

from __future__ import annotations

import ctypes
import math
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows that go to a Python worker at once.
BATCH_ROWS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints").rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on at most ``BATCH_ROWS`` rows go to a Python worker at once. Spark's 10,000 whole texts are tens of MB for each
    task, which stand as Arrow in the executor and the worker and once more as strings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """At the end of a task: give freed memory back to the system. Workers are used again, and what one step kept would stand beside the next."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: what follows survives a lost executor without doing this work again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def words_in(text: Column) -> Column:
    """The words of a text, cut at ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def id_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def remainder(c: Column, by: int) -> Column:
    """crc32 of an id as text, modulo ``by``; a null id counts as an empty text."""
    return F.crc32(id_text(c)) % by


def parts_for(rows: int, per_part: int) -> int:
    """How many parts hold ``rows`` rows at about ``per_part`` each."""
    return max(1, math.ceil(rows / per_part))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
