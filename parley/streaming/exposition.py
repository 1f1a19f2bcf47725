"""Cumulative metrics of a running stream of spans, kept as a small table that batches are merged into.

Version n of the table is version n - 1 and what batch n adds. A batch that runs twice, after a lost
driver or a failed write, builds the same version from the same one before, so it counts once.
The last ``SLOTS`` versions are kept; each has a row for every label set and bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import constants as K
from parley.operators.instruments import LABELS, error_counts, histograms, observations
from parley.sources.sinks import counter_lines, exposition_lines, with_headers

SLOTS = 4
TOTALS = (
    "metric string, model string, streaming string, status string, token_type string, le double, bucket_count long, count long, sum double, "
    "batch long, slot int"
)
#: The type line of each metric that may show up.
KINDS = {m: "histogram" for m in (K.M_DURATION, K.M_TOKENS, K.M_COMPLETION_RATE, K.M_TOTAL_RATE, K.M_CHUNKS, K.M_FIRST_TOKEN, K.M_CHUNK_DELAY, K.M_EMBED_RATE)} | {
    K.M_ERRORS: "counter"
}


def batch_totals(measured: DataFrame, policy: str = "strict") -> DataFrame:
    """Histogram rows of all metrics and, without a bound, the error counters."""
    rows = histograms(observations(measured, policy)).select(*LABELS, "le", "bucket_count", "count", "sum")
    errors = error_counts(measured).select(F.lit(K.M_ERRORS).alias("metric"), "model", "streaming", F.col("errors").alias("count"))
    return rows.unionByName(errors, allowMissingColumns=True)


def version_before(spark: SparkSession, folder: str, batch_id: int | None = None) -> DataFrame:
    """The newest totals, or the newest that are older than a batch."""
    kept = spark.read.schema(TOTALS).parquet(folder)
    kept = kept if batch_id is None else kept.where(F.col("batch") < batch_id)
    newest = kept.agg(F.max("batch")).first()[0]
    return kept.where(F.col("batch") == newest).drop("slot", "batch")


def merge_batches(folder: str, policy: str = "strict") -> Callable[[DataFrame, int], None]:
    """The function for ``foreachBatch`` of a stream of measured spans."""

    def merge(measured: DataFrame, batch_id: int) -> None:
        spark = measured.sparkSession
        spark.createDataFrame([], TOTALS).write.mode("append").partitionBy("slot").parquet(folder)  # the folder must be there
        added = batch_totals(measured, policy)
        both = version_before(spark, folder, batch_id).unionByName(added)
        totals = both.groupBy(*LABELS, "le").agg(F.sum("bucket_count").alias("bucket_count"), F.sum("count").alias("count"), F.sum("sum").alias("sum"))
        version = totals.withColumns({"batch": F.lit(batch_id).cast("long"), "slot": F.lit(batch_id % SLOTS)})
        version.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(folder)

    return merge


def exposition(totals: DataFrame) -> DataFrame:
    """(metric, rank, line): help, type and samples of histograms and counters."""
    lines = exposition_lines(totals.where("le is not null"))
    errors = totals.where(F.col("metric") == K.M_ERRORS).select("model", "streaming", F.col("count").alias("errors"))
    return with_headers(lines.unionByName(counter_lines(errors, K.M_ERRORS)), KINDS)
