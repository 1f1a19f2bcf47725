"""Queries over spans and their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import constants as K
from parley.operators import instruments, sampling, span_logs
from parley.operators import span_metrics as M
from parley.plans.derive import SPAN_EVENTS_SQL, SPANS_SQL, span_events, spans
from parley.plans.registry import query
from parley.session import shared_folder
from parley.streaming.exposition import KINDS, batch_totals, exposition, merge_batches, version_before
from parley.streaming.rollup import windowed_histograms
from parley.streaming.sampling import sample_live

_METRICS = (
    "duration_ms", "completion_tokens_per_second", "total_tokens_per_second", "chunk_delay_ms",
    "first_token_delay_ms", "embeddings_per_second", "avg_chunk_size", "avg_chunk_content_size",
)
STATS_SQL = """stats AS (
 SELECT span_id, avg(chunk_size) AS avg_chunk_size, max(chunk_size) AS max_chunk_size, min(chunk_size) AS min_chunk_size,
  avg(chunk_content_size) AS avg_chunk_content_size, count(*) FILTER (chunk_content_size > 0) AS chunks_with_content,
  count(*) FILTER (chunk_content_size = 0) AS empty_chunks, arg_min(ts_ns, seq) AS first_chunk_ns,
  arg_min(ts_ns, seq) FILTER (chunk_content_size > 0) AS first_content_ns
 FROM span_events WHERE name = 'slm.chunk_generated' GROUP BY span_id)"""
MEASURED_SQL = f"""{SPAN_EVENTS_SQL}, {STATS_SQL}, timed AS (
 SELECT *, CASE WHEN start_ns <> 0 AND end_ns <> 0 THEN (end_ns - start_ns) / 1000000.0::DOUBLE END AS duration_ms FROM spans),
measured AS (
 SELECT t.*,
  CASE WHEN duration_ms IS NOT NULL THEN CASE WHEN completion_tokens > 0 AND duration_ms > 0 THEN completion_tokens / (duration_ms / 1000) ELSE 0 END END AS completion_tokens_per_second,
  CASE WHEN duration_ms IS NOT NULL THEN CASE WHEN total_tokens > 0 AND duration_ms > 0 THEN total_tokens / (duration_ms / 1000) ELSE 0 END END AS total_tokens_per_second,
  CASE WHEN streaming AND chunk_count > 0 AND duration_ms > 0 THEN duration_ms / chunk_count END AS chunk_delay_ms,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN (first_chunk_ns - start_ns) / 1000000.0::DOUBLE END AS first_token_delay_ms,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN (first_content_ns - start_ns) / 1000000.0::DOUBLE END AS first_content_delay_ms,
  CASE WHEN name = 'slm.embedding' AND output_count > 0 AND duration_ms > 0 THEN output_count / (duration_ms / 1000) END AS embeddings_per_second,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN avg_chunk_size END AS avg_chunk_size,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN max_chunk_size END AS max_chunk_size,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN min_chunk_size END AS min_chunk_size,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN avg_chunk_content_size END AS avg_chunk_content_size,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN chunks_with_content END AS chunks_with_content,
  CASE WHEN streaming AND duration_ms IS NOT NULL THEN empty_chunks END AS empty_chunks
 FROM timed t LEFT JOIN stats USING (span_id))"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.performance(spans(spark, sf_dir), span_events(spark, sf_dir))


def _rounded(names: tuple[str, ...]) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(
    "span_filter",
    f"""WITH {SPANS_SQL} SELECT span_id, name, CASE WHEN name LIKE 'slm.chat_completion%' THEN 'chat'
     WHEN name = 'slm.embedding' THEN 'embedding' ELSE 'other' END AS kind FROM spans WHERE name LIKE 'slm%'""",
)
def span_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.own_spans(spans(spark, sf_dir)).select("span_id", "name", M.span_kind(F.col("name")).alias("kind"))


@query(
    "span_throughput",
    f"""WITH {MEASURED_SQL} SELECT span_id, round(duration_ms, 6) AS duration_ms,
     round(completion_tokens_per_second, 6) AS completion_tokens_per_second,
     round(total_tokens_per_second, 6) AS total_tokens_per_second FROM measured""",
)
def span_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("duration_ms", "completion_tokens_per_second", "total_tokens_per_second")
    return measured(spark, sf_dir).select("span_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "chunk_delay",
    f"WITH {MEASURED_SQL} SELECT span_id, round(chunk_delay_ms, 6) AS chunk_delay_ms FROM measured WHERE chunk_delay_ms IS NOT NULL",
)
def chunk_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).where("chunk_delay_ms is not null")
    return rows.select("span_id", F.round("chunk_delay_ms", 6).alias("chunk_delay_ms"))


@query(
    "first_token_delay",
    f"""WITH {MEASURED_SQL} SELECT span_id, round(first_token_delay_ms, 6) AS first_token_delay_ms,
     round(first_content_delay_ms, 6) AS first_content_delay_ms FROM measured WHERE first_token_delay_ms IS NOT NULL""",
)
def first_token_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).where("first_token_delay_ms is not null")
    content = (F.col("first_content_ns") - F.col("start_ns")) / 1_000_000
    return rows.select(
        "span_id",
        F.round("first_token_delay_ms", 6).alias("first_token_delay_ms"),
        F.round(content, 6).alias("first_content_delay_ms"),
    )


@query(
    "chunk_statistics",
    f"""WITH {SPAN_EVENTS_SQL}, {STATS_SQL} SELECT span_id, round(avg_chunk_size, 6) AS avg_chunk_size, max_chunk_size, min_chunk_size,
     round(avg_chunk_content_size, 6) AS avg_chunk_content_size, chunks_with_content, empty_chunks, first_chunk_ns, first_content_ns FROM stats""",
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = {n: F.round(n, 6) for n in ("avg_chunk_size", "avg_chunk_content_size")}
    return M.chunk_statistics(span_events(spark, sf_dir)).withColumns(rounded)


@query(
    "embedding_rate",
    f"WITH {MEASURED_SQL} SELECT span_id, round(embeddings_per_second, 6) AS embeddings_per_second FROM measured WHERE embeddings_per_second IS NOT NULL",
)
def embedding_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).where("embeddings_per_second is not null")
    return rows.select("span_id", F.round("embeddings_per_second", 6).alias("embeddings_per_second"))


def _bounds_sql() -> str:
    rows = []
    for metric, bounds in instruments.BOUNDS.items():
        rows += [f"('{metric}', {b}::DOUBLE)" for b in bounds] + [f"('{metric}', 'inf'::DOUBLE)"]
    return "bounds AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS b(metric, le))"


OBSERVED_SQL = f"""{MEASURED_SQL}, labelled AS (
 SELECT *, coalesce(model, 'unknown') AS m, name LIKE 'slm.chat_completion%' AS chat, status_code <> 'ERROR' AS fine,
  CASE WHEN name = 'slm.embedding' THEN 'embedding' WHEN streaming THEN 'streaming' ELSE 'non_streaming' END AS s,
  CASE WHEN status_code = 'OK' THEN 'success' ELSE 'error' END AS st
 FROM measured WHERE name LIKE 'slm.chat_completion%' OR name = 'slm.embedding'),
observed AS (
 SELECT '{K.M_DURATION}' AS metric, m AS model, s AS streaming, st AS status, NULL AS token_type,
  CASE WHEN duration_ms > 0 THEN duration_ms / 1000 ELSE 0 END AS value, ts FROM labelled
 UNION ALL SELECT '{K.M_TOKENS}', m, s, NULL, 'prompt', prompt_tokens, ts FROM labelled WHERE fine AND prompt_tokens > 0
 UNION ALL SELECT '{K.M_TOKENS}', m, s, NULL, 'completion', completion_tokens, ts FROM labelled WHERE fine AND chat AND completion_tokens > 0
 UNION ALL SELECT '{K.M_COMPLETION_RATE}', m, s, NULL, NULL, completion_tokens_per_second, ts FROM labelled WHERE fine AND chat AND completion_tokens_per_second > 0
 UNION ALL SELECT '{K.M_TOTAL_RATE}', m, s, NULL, NULL, total_tokens_per_second, ts FROM labelled WHERE fine AND total_tokens_per_second > 0
 UNION ALL SELECT '{K.M_CHUNKS}', m, NULL, NULL, NULL, chunk_count, ts FROM labelled WHERE fine AND streaming AND chunk_count > 0
 UNION ALL SELECT '{K.M_FIRST_TOKEN}', m, NULL, NULL, NULL, first_token_delay_ms, ts FROM labelled WHERE fine AND streaming AND first_token_delay_ms > 0
 UNION ALL SELECT '{K.M_CHUNK_DELAY}', m, NULL, NULL, NULL, chunk_delay_ms, ts FROM labelled WHERE fine AND streaming AND chunk_delay_ms > 0
 UNION ALL SELECT '{K.M_EMBED_RATE}', m, NULL, NULL, NULL, embeddings_per_second, ts FROM labelled WHERE fine AND name = 'slm.embedding' AND embeddings_per_second > 0),
{_bounds_sql()}"""

_HISTOGRAM = """SELECT {by} o.metric, model, streaming, status, token_type, le, count(*) FILTER (value <= le) AS bucket_count,
 count(*) AS count, round(sum(value), 5) AS sum FROM observed o JOIN bounds b USING (metric) GROUP BY ALL"""


@query("metric_histograms", f"WITH {OBSERVED_SQL} {_HISTOGRAM.format(by='')}")
def metric_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = instruments.histograms(instruments.observations(measured(spark, sf_dir)))
    return rows.withColumn("sum", F.round("sum", 5))


@query(
    "windowed_histograms",
    f"WITH {OBSERVED_SQL} {_HISTOGRAM.format(by='epoch(date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts))::BIGINT AS window_start,')}",
)
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = measured(spark, sf_dir).withColumn("ts", F.timestamp_micros((F.col("start_ns") / 1000).cast("long")))
    rows = windowed_histograms(timed, window="1 hour")
    return rows.select(
        F.unix_timestamp("window.start").alias("window_start"),
        *instruments.LABELS, "le", "bucket_count", "count", F.round("sum", 5).alias("sum"),
    )


@query(
    "error_counter",
    f"""WITH {SPANS_SQL} SELECT coalesce(model, 'unknown') AS model,
     CASE WHEN name = 'slm.embedding' THEN 'embedding' WHEN streaming THEN 'streaming' ELSE 'non_streaming' END AS streaming,
     count(*) AS errors FROM spans WHERE status_code = 'ERROR' AND (name LIKE 'slm.chat_completion%' OR name = 'slm.embedding') GROUP BY ALL""",
)
def error_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instruments.error_counts(spans(spark, sf_dir))


@query(
    "duration_status",
    f"""WITH {SPANS_SQL} SELECT status_code, CASE WHEN status_code = 'OK' THEN 'success' ELSE 'error' END AS strict,
     CASE WHEN status_code = 'ERROR' THEN 'error' ELSE 'success' END AS lenient, count(*) AS spans FROM spans GROUP BY ALL""",
)
def duration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("status_code")
    return spans(spark, sf_dir).groupBy(
        "status_code",
        instruments.duration_status(code).alias("strict"),
        instruments.duration_status(code, "otel").alias("lenient"),
    ).agg(F.count("*").alias("spans"))


_MODE_SQL = """CASE WHEN name = 'slm.chat_completion.streaming' THEN 'streaming' WHEN name LIKE 'slm.chat_completion%' THEN 'non-streaming'
 WHEN name = 'slm.embedding' THEN 'embedding' ELSE 'unknown' END"""


def _cells_sql(cells: dict[str, tuple[str, str]]) -> str:
    """JSON text of the numbers that a record shows: name -> (value, when it is shown)."""
    each = ", ".join(f"CASE WHEN {shown} THEN concat('\"{n}\":', CAST({value} AS VARCHAR)) END" for n, (value, shown) in cells.items())
    return f"concat('{{{{', array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ','), '}}}}')".replace("{{", "{").replace("}}", "}")


_CHAT, _LIVE, _EMBED = "mode IN ('streaming', 'non-streaming')", "mode = 'streaming'", "mode = 'embedding'"


def _two(name: str) -> str:
    """Two decimals of a number as it is written, halves to the even digit."""
    hundred = f"(CAST(CAST(coalesce({name}, 0)::DOUBLE AS VARCHAR) AS DECIMAL(38, 20)) * 100)"
    up = f"CASE WHEN {hundred} % 1 > 0.5 OR ({hundred} % 1 = 0.5 AND floor({hundred})::HUGEINT % 2 = 1) THEN 1 ELSE 0 END"
    text = f"CAST((floor({hundred})::HUGEINT + {up})::DOUBLE / 100 AS VARCHAR)"
    # From ten million on, numbers are written with an exponent.
    return rf"regexp_replace(regexp_replace(regexp_replace({text}, '^(\d)(\d{{7}})\.(\d+)$', '\1.\2\3E7'), '0+E7$', 'E7'), '\.E7$', '.0E7')"


_STARTS_SQL = _cells_sql(
    {
        "max_tokens": ("max_tokens", _CHAT), "temperature": ("temperature", _CHAT), "input_messages": ("input_messages", _CHAT),
        "input_count": ("input_count", _EMBED), "input_content_length": ("input_content_length", f"{_CHAT} OR {_EMBED}"),
    }
)
_ENDS_SQL = _cells_sql(
    {
        "duration_ms": (_two("duration_ms"), "true"), "total_tokens": ("total_tokens", "true"), "total_tokens_per_second": (_two("total_tokens_per_second"), "true"),
        "output_content_length": ("output_content_length", _CHAT), "completion_tokens": ("completion_tokens", _CHAT),
        "completion_tokens_per_second": (_two("completion_tokens_per_second"), _CHAT), "input_count": ("input_count", _EMBED), "output_count": ("output_count", _EMBED),
        "embeddings_per_second": (_two("embeddings_per_second"), _EMBED), "chunk_count": ("chunk_count", _LIVE), "avg_chunk_delay_ms": (_two("chunk_delay_ms"), _LIVE),
        "first_token_delay_ms": (_two("first_token_delay_ms"), _LIVE), "avg_chunk_size": (_two("avg_chunk_size"), _LIVE),
        "avg_chunk_content_size": (_two("avg_chunk_content_size"), _LIVE), "chunks_with_content": ("coalesce(chunks_with_content, 0)", _LIVE),
        "empty_chunks": ("coalesce(empty_chunks, 0)", _LIVE),
    }
)


@query(
    "span_logs",
    f"""WITH {MEASURED_SQL}, own AS (SELECT *, {_MODE_SQL} AS mode FROM measured WHERE name LIKE 'slm%')
     SELECT span_id, 'starting' AS phase, 'info' AS level, start_ns AS ts_ns, mode, concat('[SLM] starting ', mode, ': ', {_STARTS_SQL}) AS message FROM own
     UNION ALL SELECT span_id, 'failed', 'error', end_ns, mode, concat('[SLM] failed: ', status_description) FROM own WHERE status_code = 'ERROR'
     UNION ALL SELECT span_id, 'completed', 'info', end_ns, mode, concat('[SLM] completed ', mode, ': ', {_ENDS_SQL}) FROM own WHERE status_code <> 'ERROR'""",
)
def span_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_logs.span_log_records(measured(spark, sf_dir)).select("span_id", "phase", "level", "ts_ns", "mode", "message")


@query(
    "trace_sample",
    f"""WITH {SPANS_SQL} SELECT span_id, trace_id, force_sample FROM spans WHERE substr(trace_id, 17, 16) < '{round(0.1 * 2**64):016x}'
     OR trace_id IN (SELECT trace_id FROM spans WHERE force_sample)""",
)
def trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_spans(spans(spark, sf_dir)).select("span_id", "trace_id", "force_sample")


@query(
    "trace_ratio",
    f"""WITH {SPANS_SQL} SELECT trace_id, count(*) AS spans FROM spans
     WHERE CAST(concat('0x', substr(trace_id, 17, 16)) AS UBIGINT) < {round(0.25 * 2**64)}::UBIGINT GROUP BY trace_id""",
)
def trace_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans(spark, sf_dir).where(sampling.within_ratio(F.col("trace_id"), 0.25))
    return kept.groupBy("trace_id").agg(F.count("*").alias("spans"))


_HELP_SQL = ", ".join(f"('{m}', '{K.METRIC_HELP[m]}', '{kind}')" for m, kind in KINDS.items())
EXPOSITION_SQL = f"""WITH {OBSERVED_SQL}, h AS ({_HISTOGRAM.format(by='')}),
     l AS (SELECT *, concat('model="', model, '"', coalesce(',streaming="' || streaming || '"', ''), coalesce(',status="' || status || '"', ''),
      coalesce(',token_type="' || token_type || '"', '')) AS labels FROM h),
     samples AS (
      SELECT metric, concat(metric, '_bucket{{', labels, ',le="', CASE WHEN le = 'inf'::DOUBLE THEN '+Inf' ELSE CAST(le AS VARCHAR) END, '"}} ', bucket_count) AS line FROM l
      UNION ALL SELECT metric, concat(metric, '_count{{', labels, '}} ', count) FROM l WHERE le = 'inf'::DOUBLE
      UNION ALL SELECT metric, concat(metric, '_sum{{', labels, '}} ', CAST(sum AS DECIMAL(38, 3))) FROM l WHERE le = 'inf'::DOUBLE
      UNION ALL SELECT '{K.M_ERRORS}', concat('{K.M_ERRORS}{{model="', m, '",streaming="', s, '"}} ', count(*)) FROM labelled WHERE status_code = 'ERROR' GROUP BY m, s),
     headers AS (SELECT * FROM (VALUES {_HELP_SQL}) AS t(metric, help, kind) WHERE metric IN (SELECT metric FROM samples))
     SELECT metric, 2 AS rank, line FROM samples
     UNION ALL SELECT metric, 0, concat('# HELP ', metric, ' ', help) FROM headers
     UNION ALL SELECT metric, 1, concat('# TYPE ', metric, ' ', kind) FROM headers"""


@query("metric_exposition", EXPOSITION_SQL)
def metric_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposition(batch_totals(measured(spark, sf_dir)))


def _as_stream(spark: SparkSession, rows: DataFrame, purpose: str, files: int) -> tuple[DataFrame, str]:
    """Rows written as files and read as a stream, half of the files in each micro-batch; and the folder."""
    folder = shared_folder(spark, purpose)
    rows.repartition(files, "span_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{folder}/in"), folder


@query("live_exposition", EXPOSITION_SQL)
def live_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, folder = _as_stream(spark, measured(spark, sf_dir), "live-metrics", 8)
    merge = merge_batches(f"{folder}/totals")

    def twice(batch: DataFrame, batch_id: int) -> None:
        # As after a driver that was lost behind the write: the batch comes again.
        merge(batch, batch_id)
        merge(batch, batch_id)

    run = live.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return exposition(version_before(spark, f"{folder}/totals"))


@query(
    "live_trace_sample",
    f"""WITH {SPANS_SQL} SELECT span_id, trace_id, force_sample, start_ns FROM spans WHERE substr(trace_id, 17, 16) < '{round(0.1 * 2**64):016x}'
     OR trace_id IN (SELECT trace_id FROM spans WHERE force_sample)""",
)
def live_trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, folder = _as_stream(spark, spans(spark, sf_dir), "live-sample", 8)
    kept = sample_live(live, wait_ms=None)
    run = kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(kept.schema).parquet(f"{folder}/out").select("span_id", "trace_id", "force_sample", "start_ns")
