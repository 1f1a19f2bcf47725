"""Usage of chunk streams: totals, running counters and chunk events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import EVENT_CHUNK
from parley.operators.prefix import BLOCK_ROWS, running_sums


def _said() -> Column:
    return F.length(F.coalesce(F.col("content"), F.lit("")))


def as_spoken(outputs: DataFrame) -> DataFrame:
    """Output chunks (``replay.output_chunks``) as rows with content and reasoning_content, for the functions below."""
    content = F.when(F.col("kind").isin("content", "error", "passthrough"), F.col("text"))
    return outputs.withColumns({"content": content, "reasoning_content": F.when(F.col("kind") == "reasoning", F.col("text"))})


def stream_usage(chunks: DataFrame, prompt_tokens: DataFrame | None = None) -> DataFrame:
    """Per stream: only output chunks with content count, one token each.

    ``prompt_tokens`` (stream_id, prompt_tokens) adds the estimate of the request.
    """
    counts = chunks.groupBy("stream_id").agg(
        F.count_if(_said() > 0).alias("completion_tokens"),
        F.sum(_said()).cast("long").alias("output_content_length"),
        F.count_if(_said() > 0).alias("chunk_count"),
        F.count_if(F.length("reasoning_content") > 0).alias("reasoning_chunks")
        if "reasoning_content" in chunks.columns
        else F.lit(0).cast("long").alias("reasoning_chunks"),
        F.count("*").alias("chunk_events"),
    )
    if prompt_tokens is None:
        return counts
    return counts.join(prompt_tokens, "stream_id", "left").withColumns(
        {
            "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0).cast("long")),
            "total_tokens": F.coalesce("prompt_tokens", F.lit(0)) + F.col("completion_tokens"),
        }
    )


def running_usage(chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The counters as they stand when all output of each chunk is out."""
    each = chunks.groupBy("stream_id", "seq").agg(F.count_if(_said() > 0).alias("_tokens"), F.sum(_said()).cast("long").alias("_chars"))
    sums = {"completion_tokens": F.col("_tokens"), "output_content_length": F.col("_chars")}
    return running_sums(each, ["stream_id"], "seq", sums, block_rows)


def wire_size(record: Column) -> Column:
    """Characters of the record's JSON form."""
    return F.length(F.to_json(record)).cast("long")


def chunk_events(chunks: DataFrame, span_id: Column, ts_ns: Column, size: Column) -> DataFrame:
    """One span event per output chunk, empty ones included."""
    return chunks.select(
        span_id.alias("span_id"),
        "seq",
        F.lit(EVENT_CHUNK).alias("name"),
        ts_ns.alias("ts_ns"),
        size.alias("chunk_size"),
        _said().cast("long").alias("chunk_content_size"),
        F.nullif("finish_reason", F.lit("")).alias("finish_reason"),
    )
