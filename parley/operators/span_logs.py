"""Log records of spans: started, completed, failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import LOG_COMPLETED, LOG_FAILED, LOG_STARTING
from parley.functions.text import round_half_even
from parley.operators.span_metrics import own_spans, span_kind


# Names of the numbers a record may hold, in the order they are told.
LOG_FIELDS = (
    "max_tokens", "temperature", "input_messages", "duration_ms", "total_tokens", "total_tokens_per_second",
    "output_content_length", "completion_tokens", "completion_tokens_per_second", "input_count",
    "input_content_length", "output_count", "embeddings_per_second", "chunk_count", "avg_chunk_delay_ms",
    "first_token_delay_ms", "avg_chunk_size", "avg_chunk_content_size", "chunks_with_content", "empty_chunks",
)


def _long(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("long")


def _two_digits(name: str) -> Column:
    return round_half_even(F.coalesce(name, F.lit(0.0)).cast("double"))


def span_log_records(measured: DataFrame) -> DataFrame:
    """Two records per span: its start, and how it ended.

    ``fields`` holds the numbers of the record; those that do not belong to the
    phase and kind of span are null, and the message leaves them out. All
    records come from one pass over the spans.
    """
    spans = own_spans(measured).withColumn("kind", span_kind(F.col("name")))
    streaming = F.coalesce("streaming", F.lit(False))
    chat, embedding = F.col("kind") == "chat", F.col("kind") == "embedding"
    mode = (
        F.when(chat & streaming, F.lit("streaming"))
        .when(chat, F.lit("non-streaming"))
        .when(embedding, F.lit("embedding"))
        .otherwise(F.lit("unknown"))
    )
    failed = F.col("status_code").eqNullSafe("ERROR")
    ends = {
        **{n: (_two_digits(n), None) for n in ("duration_ms", "total_tokens_per_second")},
        "total_tokens": (_long("total_tokens"), None),
        **{n: (_long(n), chat) for n in ("output_content_length", "completion_tokens")},
        "completion_tokens_per_second": (_two_digits("completion_tokens_per_second"), chat),
        **{n: (_long(n), chat & streaming) for n in ("chunk_count", "chunks_with_content", "empty_chunks")},
        "avg_chunk_delay_ms": (_two_digits("chunk_delay_ms"), chat & streaming),
        **{
            n: (_two_digits(n), chat & streaming)
            for n in ("first_token_delay_ms", "avg_chunk_size", "avg_chunk_content_size")
        },
        **{n: (_long(n), embedding) for n in ("input_count", "output_count")},
        "embeddings_per_second": (_two_digits("embeddings_per_second"), embedding),
    }
    starts = {
        **{n: (_long(n), chat) for n in ("max_tokens", "input_messages")},
        "temperature": (F.coalesce("temperature", F.lit(0.0)), chat),
        "input_content_length": (_long("input_content_length"), chat | embedding),
        "input_count": (_long("input_count"), embedding),
    }
    fractions = ("temperature", "_ms", "_per_second", "_size")
    types = {n: "double" if n.endswith(fractions) else "long" for n in LOG_FIELDS}

    def fields(given: dict[str, tuple[Column, Column | None]]) -> Column:
        cells = []
        for n in LOG_FIELDS:
            value, shown = given.get(n, (F.lit(None), None))
            cells.append((value if shown is None else F.when(shown, value)).cast(types[n]).alias(n))
        return F.struct(*cells)

    def record(phase: str, level: str, ts: str, numbers: Column) -> Column:
        return F.struct(
            F.lit(phase).alias("phase"),
            F.lit(level).alias("level"),
            F.col(ts).alias("ts_ns"),
            mode.alias("mode"),
            numbers.alias("fields"),
        )

    records = F.array(
        record("starting", "info", "start_ns", fields(starts)),
        F.when(failed, record("failed", "error", "end_ns", fields({}))).otherwise(
            record("completed", "info", "end_ns", fields(ends))
        ),
    )
    numbers = F.to_json("fields")
    message = (
        F.when(F.col("phase") == "starting", F.format_string(_printf(LOG_STARTING), "mode", numbers))
        .when(F.col("phase") == "completed", F.format_string(_printf(LOG_COMPLETED), "mode", numbers))
        .otherwise(F.format_string(_printf(LOG_FAILED), F.coalesce("status_description", F.lit("None"))))
    )
    return spans.select("span_id", "status_description", F.inline(records)).select(
        "span_id", "phase", "level", "ts_ns", "mode", "fields", message.alias("message")
    )


def _printf(template: str) -> str:
    return template.replace("{}", "%s")
