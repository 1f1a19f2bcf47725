import json
import random

import pytest
from pyspark.sql import functions as F

from parley import constants as K
from parley.operators import instruments, sampling, span_logs, usage
from parley.operators import span_metrics as M
from parley.schemas import SPAN, SPAN_EVENT
from parley.sources import sinks
from parley.streaming.rollup import windowed_histograms

S = 1_000_000_000
CHAT, LIVE = "slm.chat_completion.non_streaming", "slm.chat_completion.streaming"


def spans(spark, *rows):
    names = [p.split()[0] for p in SPAN.split(", ")]
    base = dict.fromkeys(names) | {"trace_id": "0" * 32, "status_code": "OK", "model": "test-model"}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SPAN)


def events(spark, *rows):
    names = [p.split()[0] for p in SPAN_EVENT.split(", ")]
    base = dict.fromkeys(names) | {"name": K.EVENT_CHUNK}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SPAN_EVENT)


@pytest.fixture(scope="module")
def measured(spark):
    given = spans(
        spark,
        dict(span_id="plain", name=CHAT, start_ns=S, end_ns=2 * S, streaming=False, prompt_tokens=50, total_tokens=100, completion_tokens=50),
        dict(span_id="live", name=LIVE, start_ns=S, end_ns=2 * S, streaming=True, chunk_count=3, prompt_tokens=15, completion_tokens=25, total_tokens=40),
        dict(span_id="untimed", name=CHAT, start_ns=0, end_ns=2 * S, streaming=False, status_code="ERROR", status_description="boom"),
        dict(span_id="vec", name=K.SPAN_EMBEDDING, start_ns=S, end_ns=3 * S, output_count=4, input_count=4, model=None),
        dict(span_id="unset", name=CHAT, start_ns=S, end_ns=S, streaming=False, status_code="UNSET", completion_tokens=5, total_tokens=5),
        dict(span_id="http", name="http.request", start_ns=S, end_ns=2 * S),
        dict(span_id="other", name="slm.other", start_ns=S, end_ns=2 * S),
    )
    chunks = events(
        spark,
        *[dict(span_id="live", seq=i, ts_ns=S + (i + 1) * 100_000_000, chunk_size=size, chunk_content_size=content)
          for i, (size, content) in enumerate([(100, 0), (110, 5), (120, 5), (130, 1)])],
        dict(span_id="live", seq=9, name="other.event", ts_ns=S, chunk_size=1),
        dict(span_id="live", seq=10, ts_ns=2 * S, chunk_size=None, chunk_content_size=None),
    )
    return M.performance(given, chunks).cache()


def test_performance(measured):
    r = {x.span_id: x for x in measured.collect()}
    assert (r["plain"].duration_ms, r["plain"].completion_tokens_per_second, r["plain"].total_tokens_per_second) == (1000, 50, 100)
    assert r["plain"].first_token_delay_ms is None and r["plain"].avg_chunk_size is None
    live = r["live"]
    assert live.chunk_delay_ms == pytest.approx(1000 / 3) and live.first_token_delay_ms == 100
    assert (live.avg_chunk_size, live.max_chunk_size, live.min_chunk_size) == (92, 130, 0)
    assert live.avg_chunk_content_size == pytest.approx(11 / 5)
    assert (live.chunks_with_content, live.empty_chunks) == (3, 2)
    assert r["untimed"].duration_ms is None and r["untimed"].total_tokens_per_second is None
    assert r["vec"].embeddings_per_second == 2
    assert (r["unset"].duration_ms, r["unset"].completion_tokens_per_second) == (0, 0)


def test_histograms_and_errors(measured):
    rows = instruments.histograms(instruments.observations(measured)).collect()
    def pick(metric, **labels):
        return {r.le: (r.bucket_count, r["count"], r.sum) for r in rows
                if r.metric == metric and all(r[k] == v for k, v in labels.items())}
    ok = pick(K.M_DURATION, streaming="non_streaming", status="success")
    assert ok[0.5] == (0, 1, 1.0) and ok[1.0] == (1, 1, 1.0) and ok[float("inf")][0] == 1 and len(ok) == 9
    failed = pick(K.M_DURATION, streaming="non_streaming", status="error")
    assert failed[0.1] == (2, 2, 0.0)
    assert pick(K.M_TOKENS, streaming="streaming", token_type="prompt")[50.0] == (1, 1, 15.0)
    assert pick(K.M_TOKENS, streaming="streaming", token_type="completion")[10.0] == (0, 1, 25.0)
    assert pick(K.M_FIRST_TOKEN, model="test-model")[100.0] == (1, 1, 100.0)
    assert pick(K.M_EMBED_RATE, model="unknown")[1.0][0] == 0
    assert not pick(K.M_CHUNK_DURATION)
    assert {r.status for r in rows if r.streaming == "embedding" and r.metric == K.M_DURATION} == {"success"}
    errors = [tuple(r) for r in instruments.error_counts(measured).collect()]
    assert errors == [("test-model", "non_streaming", 1)]


def test_status_policy(spark):
    codes = spark.createDataFrame([("OK",), ("UNSET",), ("ERROR",), (None,)], "c string")
    c = F.col("c")
    rows = codes.select(instruments.duration_status(c).alias("a"), instruments.duration_status(c, "otel").alias("b")).collect()
    assert [r.a for r in rows] == ["success", "error", "error", "error"]
    assert [r.b for r in rows] == ["success", "success", "error", "success"]


def test_logs(measured, tmp_path):
    records = span_logs.span_log_records(measured)
    rows = {(r.span_id, r.phase): r for r in records.collect()}
    assert len(rows) == 12 and not any(k[0] == "http" for k in rows)
    assert rows["untimed", "failed"].message == "[SLM] failed: boom" and rows["untimed", "failed"].level == "error"
    live = rows["live", "completed"]
    assert live.mode == "streaming" and live.message.startswith("[SLM] completed streaming: {")
    told = json.loads(live.message.split(": ", 1)[1])
    assert told["avg_chunk_delay_ms"] == 333.33 and told["chunk_count"] == 3 and "input_count" not in told
    assert json.loads(rows["plain", "completed"].message.split(": ", 1)[1]).keys() == {
        "duration_ms", "total_tokens", "total_tokens_per_second", "output_content_length", "completion_tokens", "completion_tokens_per_second"}
    assert rows["vec", "starting"].fields.input_count == 4 and rows["other", "starting"].mode == "unknown"
    sinks.write_span_logs(records, str(tmp_path / "logs"))
    assert records.sparkSession.read.json(str(tmp_path / "logs")).count() == 12


def test_exposition(measured, tmp_path):
    lines = sinks.exposition_lines(instruments.histograms(instruments.observations(measured)))
    counters = sinks.counter_lines(instruments.error_counts(measured), K.M_ERRORS)
    kinds = {m: "histogram" for m in instruments.BOUNDS} | {K.M_ERRORS: "counter"}
    sinks.write_exposition(sinks.with_headers(lines.unionByName(counters), kinds), str(tmp_path / "m"))
    text = [r.value for r in lines.sparkSession.read.text(str(tmp_path / "m")).collect()]
    assert 'slm_errors_total{model="test-model",streaming="non_streaming"} 1' in text
    assert 'slm_completion_duration_seconds_bucket{model="test-model",streaming="non_streaming",status="success",le="+Inf"} 1' in text
    assert text.index("# TYPE slm_errors_total counter") + 1 == text.index('slm_errors_total{model="test-model",streaming="non_streaming"} 1')


def test_sampling_keeps_whole_traces(spark, tmp_path):
    rng = random.Random(5)
    traces = [f"{rng.getrandbits(128):032x}" for _ in range(60)]
    rows = [dict(span_id=str(i), name=CHAT, trace_id=traces[0] if i % 3 == 0 else rng.choice(traces), force_sample=rng.random() < 0.01 or None)
            for i in range(1500)]
    df = spans(spark, *rows)
    forced = {r["trace_id"] for r in rows if r["force_sample"]}
    keep = {r["span_id"] for r in rows if r["trace_id"] in forced or int(r["trace_id"][16:], 16) < round(0.2 * 2**64)}
    out = sampling.sampled_spans(df, 0.2)
    got = [r.span_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == keep and out.columns == df.columns
    sinks.export_sampled(df, str(tmp_path / "s"), 0.2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(keep)
    assert sampling.sampled_spans(df, 1.0).count() == 1500
    assert set(r.span_id for r in sampling.sampled_spans(df, 0.0).collect()) == {
        r["span_id"] for r in rows if r["trace_id"] in forced}


def test_stream_usage_and_running_counters(spark):
    rows = [("hot", i, "x" * (i % 3), None) for i in range(500)] + [("a", 0, "Hi", None), ("a", 1, " there!", None), ("a", 2, "", "stop")]
    df = spark.createDataFrame(rows, "stream_id string, seq long, content string, finish_reason string")
    prompts = spark.createDataFrame([("a", 2)], "stream_id string, prompt_tokens long")
    r = {x.stream_id: x for x in usage.stream_usage(df, prompts).collect()}["a"]
    assert (r.completion_tokens, r.output_content_length, r.total_tokens, r.chunk_count, r.chunk_events) == (2, 9, 4, 2, 3)
    for block in (1, 7, 4096):
        got = sorted((x.stream_id, x.seq, x.completion_tokens, x.output_content_length) for x in usage.running_usage(df, block).collect())
        want, tokens, length = [], {}, {}
        for s, q, c, _ in sorted(rows):
            tokens[s] = tokens.get(s, 0) + bool(c)
            length[s] = length.get(s, 0) + len(c)
            want.append((s, q, tokens[s], length[s]))
        assert got == want


def test_live_rollup(spark, measured, tmp_path):
    timed = measured.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("start_ns") / S))
    later = timed.where("span_id = 'plain'").withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    for part, rows in (("a", timed), ("b", later)):
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / part))
        live = spark.readStream.schema(timed.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = (windowed_histograms(live).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
        assert q.awaitTermination(120)
    only = "streaming = 'streaming' and metric = 'slm_completion_duration_seconds'"
    got = {r.le: r.bucket_count for r in spark.read.parquet(str(tmp_path / "out")).where(only).collect()}
    assert got[1.0] == 1 and got[0.5] == 0
    static = windowed_histograms(timed).where(only)
    assert {r.le: r.bucket_count for r in static.collect()} == got


def test_url_filter(spark):
    urls = spark.createDataFrame([("/metrics",), ("/api/v1/chat",), ("/health?x",)], "u string")
    assert [r.u for r in urls.where(M.not_excluded(F.col("u"))).collect()] == ["/api/v1/chat"]
