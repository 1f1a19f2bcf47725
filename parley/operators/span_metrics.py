"""Performance numbers of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import EVENT_CHUNK, EXCLUDED_URLS, SPAN_CHAT, SPAN_EMBEDDING, SPAN_PREFIX


def own_spans(spans: DataFrame) -> DataFrame:
    """Spans of this kind of traffic; the prefix filter reaches the scan."""
    return spans.where(F.col("name").startswith(SPAN_PREFIX))


def span_kind(name: Column) -> Column:
    return (
        F.when(name.startswith(SPAN_CHAT), F.lit("chat"))
        .when(name == SPAN_EMBEDDING, F.lit("embedding"))
        .otherwise(F.lit("other"))
    )


def not_excluded(url: Column, patterns: tuple[str, ...] = EXCLUDED_URLS) -> Column:
    """Keep a URL when none of the patterns is found in it."""
    return ~F.rlike(url, F.lit("|".join(patterns))) if patterns else F.lit(True)


def chunk_statistics(events: DataFrame) -> DataFrame:
    """Per span: sizes of its chunk events and the first of them. Spans without any give no row."""
    size = F.coalesce("chunk_size", F.lit(0))
    content = F.coalesce("chunk_content_size", F.lit(0))
    return (
        events.where(F.col("name") == EVENT_CHUNK)
        .groupBy("span_id")
        .agg(
            F.avg(size).alias("avg_chunk_size"),
            F.max(size).cast("long").alias("max_chunk_size"),
            F.min(size).cast("long").alias("min_chunk_size"),
            F.avg(content).alias("avg_chunk_content_size"),
            F.count_if(content > 0).alias("chunks_with_content"),
            F.count_if(content <= 0).alias("empty_chunks"),
            F.min_by("ts_ns", "seq").alias("first_chunk_ns"),
            F.min_by("ts_ns", F.when(content > 0, F.col("seq"))).alias("first_content_ns"),
        )
    )


def _rate(count: Column, ms: Column) -> Column:
    return F.when((count > 0) & (ms > 0), count / (ms / 1000))


def performance(spans: DataFrame, events: DataFrame, first: str = "first_chunk_ns") -> DataFrame:
    """Add duration, rates and delays to every span.

    A span without start or end (0 counts as missing) keeps null everywhere.
    ``first`` picks which chunk ends the first-token delay: any chunk, or
    ``first_content_ns`` for the first one with content.
    """
    timed = (F.col("start_ns") != 0) & (F.col("end_ns") != 0)
    ms = F.when(timed, (F.col("end_ns") - F.col("start_ns")) / 1_000_000)
    streaming = F.coalesce("streaming", F.lit(False))
    live = F.col("duration_ms").isNotNull()
    zero = F.lit(0.0)
    base = spans.withColumn("duration_ms", ms)
    stats = chunk_statistics(events)
    joined = base.join(stats, "span_id", "left")
    shown = live & streaming
    return joined.withColumns(
        {
            "completion_tokens_per_second": F.when(
                live, F.coalesce(_rate(F.col("completion_tokens"), F.col("duration_ms")), zero)
            ),
            "total_tokens_per_second": F.when(
                live, F.coalesce(_rate(F.col("total_tokens"), F.col("duration_ms")), zero)
            ),
            "chunk_delay_ms": F.when(
                shown & (F.col("chunk_count") > 0) & (F.col("duration_ms") > 0),
                F.col("duration_ms") / F.col("chunk_count"),
            ),
            "first_token_delay_ms": F.when(shown, (F.col(first) - F.col("start_ns")) / 1_000_000),
            "embeddings_per_second": F.when(
                live & ~streaming & (F.col("name") == SPAN_EMBEDDING),
                _rate(F.col("output_count"), F.col("duration_ms")),
            ),
            **{
                c: F.when(shown, F.col(c))
                for c in (
                    "avg_chunk_size",
                    "max_chunk_size",
                    "min_chunk_size",
                    "avg_chunk_content_size",
                    "chunks_with_content",
                    "empty_chunks",
                )
            },
        }
    )
