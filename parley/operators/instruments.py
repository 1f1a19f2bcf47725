"""Labelled histograms and counters over spans: one pass, one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley import constants as K
from parley.operators.span_metrics import own_spans, span_kind

LABELS = ["metric", "model", "streaming", "status", "token_type"]
N_BOUNDS = 8
BOUNDS = {
    K.M_DURATION: K.SECONDS_BOUNDS,
    K.M_TOKENS: K.TOKEN_BOUNDS,
    K.M_COMPLETION_RATE: K.RATE_BOUNDS,
    K.M_TOTAL_RATE: K.RATE_BOUNDS,
    K.M_FIRST_TOKEN: K.DELAY_BOUNDS,
    K.M_CHUNK_DELAY: K.RATE_BOUNDS,
    K.M_CHUNKS: K.RATE_BOUNDS,
    K.M_EMBED_RATE: K.RATE_BOUNDS,
}


def duration_status(status_code: Column, policy: str = "strict") -> Column:
    """``success`` for OK only; with policy ``otel`` an unset status is a success, too."""
    good = status_code.isin("OK", "UNSET") if policy == "otel" else status_code == "OK"
    return F.when(F.coalesce(good, F.lit(policy == "otel")), F.lit("success")).otherwise(F.lit("error"))


def streaming_label(kind: Column, streaming: Column) -> Column:
    return (
        F.when(kind == "embedding", F.lit("embedding"))
        .when(F.coalesce(streaming, F.lit(False)), F.lit("streaming"))
        .otherwise(F.lit("non_streaming"))
    )


def _bucket(value: Column, bounds: tuple[float, ...]) -> Column:
    """Index of the first bound that is not below the value; the last index is +Inf."""
    index = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        index = F.when(value <= bounds[i], F.lit(i)).otherwise(index)
    return index


def observations(measured: DataFrame, policy: str = "strict") -> DataFrame:
    """Every observed value of every span: metric, labels, value, bucket."""
    spans = own_spans(measured).select(
        "*",
        span_kind(F.col("name")).alias("kind"),
        F.coalesce("model", F.lit(K.UNKNOWN_MODEL)).alias("model_label"),
        duration_status(F.col("status_code"), policy).alias("status_label"),
        (F.col("status_code") == "ERROR").alias("failed"),
    ).where("kind <> 'other'")
    chat, fine = F.col("kind") == "chat", ~F.coalesce(F.col("failed"), F.lit(False))
    live = chat & F.coalesce("streaming", F.lit(False))
    label = streaming_label(F.col("kind"), F.col("streaming"))
    none = F.lit(None).cast("string")
    seconds = F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000).otherwise(F.lit(0.0))

    def observe(metric: str, value: Column, when: Column, streaming=none, status=none, token_type=none) -> Column:
        v = value.cast("double")
        return F.when(
            F.coalesce(when, F.lit(False)),
            F.struct(
                F.lit(metric).alias("metric"),
                F.col("model_label").alias("model"),
                streaming.alias("streaming"),
                status.alias("status"),
                token_type.alias("token_type"),
                v.alias("value"),
                _bucket(v, BOUNDS[metric]).alias("bucket"),
            ),
        )

    def positive(name: str) -> Column:
        return fine & (F.col(name) > 0)

    seen = F.array(
        observe(K.M_DURATION, seconds, F.lit(True), label, F.col("status_label")),
        observe(K.M_TOKENS, F.col("prompt_tokens"), positive("prompt_tokens"), label, token_type=F.lit("prompt")),
        observe(
            K.M_TOKENS,
            F.col("completion_tokens"),
            chat & positive("completion_tokens"),
            label,
            token_type=F.lit("completion"),
        ),
        observe(
            K.M_COMPLETION_RATE,
            F.col("completion_tokens_per_second"),
            chat & positive("completion_tokens_per_second"),
            label,
        ),
        observe(K.M_TOTAL_RATE, F.col("total_tokens_per_second"), positive("total_tokens_per_second"), label),
        observe(K.M_CHUNKS, F.col("chunk_count"), live & positive("chunk_count")),
        observe(K.M_FIRST_TOKEN, F.col("first_token_delay_ms"), live & positive("first_token_delay_ms")),
        observe(K.M_CHUNK_DELAY, F.col("chunk_delay_ms"), live & positive("chunk_delay_ms")),
        observe(
            K.M_EMBED_RATE,
            F.col("embeddings_per_second"),
            (F.col("kind") == "embedding") & positive("embeddings_per_second"),
        ),
    )
    extra = [c for c in ("window",) if c in measured.columns]
    return spans.select(*extra, F.inline(F.array_compact(seen)))


def histograms(observed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cumulative buckets (``le``), sum and count per metric and label set.

    Counts of all buckets come from one aggregation that combines before the
    shuffle; only its few result rows are unfolded into one row per bound.
    """
    totals = observed.groupBy(*by, *LABELS).agg(
        F.sum("value").alias("sum"),
        F.count("*").alias("count"),
        *[F.count_if(F.col("bucket") <= i).alias(f"_le{i}") for i in range(N_BOUNDS)],
    )
    bounds = F.create_map(
        *[x for m, b in BOUNDS.items() for x in (F.lit(m), F.array(*[F.lit(v) for v in b]))]
    )
    rows = F.array(
        *[
            F.struct(F.get(F.col("_bounds"), F.lit(i)).alias("le"), F.col(f"_le{i}").alias("bucket_count"))
            for i in range(N_BOUNDS)
        ],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket_count")),
    )
    return totals.withColumn("_bounds", F.try_element_at(bounds, F.col("metric"))).select(
        *by, *LABELS, "sum", "count", F.inline(rows)
    )


def error_counts(spans: DataFrame) -> DataFrame:
    """Failed spans per model and kind of traffic."""
    return (
        own_spans(spans)
        .withColumn("kind", span_kind(F.col("name")))
        .where("kind <> 'other'")
        .groupBy(
            F.coalesce("model", F.lit(K.UNKNOWN_MODEL)).alias("model"),
            streaming_label(F.col("kind"), F.col("streaming")).alias("streaming"),
        )
        .agg(F.count_if(F.col("status_code") == "ERROR").alias("errors"))
        .where("errors > 0")
    )
