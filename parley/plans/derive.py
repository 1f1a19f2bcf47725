"""Inputs derived from the given tables, in Spark and as SQL common table expressions.

The given tables hold no tags, requests, chunks or spans. Fixed rules on the
columns make them; expressions that both engines read alike are shared text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import WHITESPACE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WS = WHITESPACE

# Patterns of the SQL, written by hand: white space; complete blocks; tokens of a stream (a tag, a started tag with
# what broke it, other text, a started tag at the end).
SQL_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_THINK = r"(?s)<think>(.*?)</think>"
SQL_CALL = rf"(?s)<tool_call>{SQL_SPACE}*(\{{.*?\}}){SQL_SPACE}*</tool_call>"
SQL_TOKEN = (
    r"(?s)</?think>|</?tool_call>|<[^/t]|</[^t]|</?t[^ho]|</?th[^i]|</?thi[^n]|</?thin[^k]|</?think[^>]|</?to[^o]|</?too[^l]|</?tool[^_]"
    r"|</?tool_[^c]|</?tool_c[^a]|</?tool_ca[^l]|</?tool_cal[^l]|</?tool_call[^>]|[^<]+"
    r"|</?(?:t|th|thi|thin|think|to|too|tool|tool_|tool_c|tool_ca|tool_cal|tool_call)?\z"
)

# Completion texts with every form of tags, good and bad.
RAW_VARIANT = "(conv_id * 3 + turn) % 16"
RAW_CONTENT = f"""CASE {RAW_VARIANT}
 WHEN 0 THEN text
 WHEN 1 THEN concat('<think>', text, '</think>', chr(10), 'Answer ', turn)
 WHEN 2 THEN concat('<think>', chr(10), chr(10), '</think>', chr(10), chr(10), text)
 WHEN 3 THEN concat('<think>First ', conv_id, '</think>', chr(10), text, chr(10), '<think> second </think>', chr(10), 'end')
 WHEN 4 THEN concat('<think>', text, '</think>')
 WHEN 5 THEN concat('<tool_call>', chr(10), '{{"name": "get_weather", "arguments": {{"conv": ', conv_id,
      ', "city": "Zürich", "days": [1, 2.5, true]}}}}', chr(10), '</tool_call>')
 WHEN 6 THEN concat(text, '<tool_call>{{"name": "a", "arguments": {{}}}}</tool_call> and ',
      '<tool_call> {{"name": "b", "arguments": "raw text"}} </tool_call> tail')
 WHEN 7 THEN concat('<tool_call>{{"name"', CASE turn % 3 WHEN 0 THEN ' "broken"}}' WHEN 1 THEN ': "f"}}] {{"x": 1}}' ELSE ': "f", "name": "g"}}' END, '</tool_call>', text)
 WHEN 8 THEN concat('<think>plan <tool_call>{{"name": "inner"}}</tool_call></think>', text)
 WHEN 9 THEN concat('<think>', text, CASE WHEN turn % 2 = 0 THEN '</thi' ELSE '' END)
 WHEN 10 THEN concat(text, '</think> stray <thi')
 WHEN 11 THEN '<tool_call>{{"name": "nulls", "arguments": null}}</tool_call>'
 WHEN 12 THEN concat('<tool_call>{{"arguments": {{"a": 1}}}}</tool_call>', text)
 WHEN 13 THEN concat(text, '<tool_call>{{"name": "open"', CASE WHEN turn % 2 = 0 THEN '</to' ELSE '' END)
 WHEN 14 THEN concat('<<think>', text, '</think>')
 ELSE '' END"""

RAW_SQL = f"""raw AS (
 SELECT conv_id, turn, concat(conv_id, '-', turn) AS stream_id, {RAW_CONTENT} AS content
 FROM conversations WHERE role = 'assistant')"""


# JSON as the jobs take it: DuckDB lets doubled keys and NaN pass.
STRICT_JSON = "CASE WHEN json_valid({b}) THEN len(json_keys({b})) = len(list_distinct(json_keys({b}))) AND NOT contains({b}, 'NaN') ELSE false END"


def raw_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, stream_id, content): raw model output per assistant turn."""
    return (
        table(spark, sf_dir, "conversations")
        .where("role = 'assistant'")
        .select(
            "conv_id",
            "turn",
            F.expr("concat(conv_id, '-', turn)").alias("stream_id"),
            F.expr(RAW_CONTENT).alias("content"),
        )
    )


# Chunk streams: a chunk with the role, pieces of seven characters, a finishing chunk.
PIECE = "(?s).{1,7}"
CHUNKS_SQL = f"""{RAW_SQL}, cut AS (
 SELECT stream_id, list_concat([NULL::VARCHAR], regexp_extract_all(content, '{PIECE}'), [NULL::VARCHAR]) AS texts FROM raw),
chunks AS (
 SELECT stream_id, seq, content,
  CASE WHEN seq = 0 THEN 'assistant' END AS role,
  CASE WHEN seq = n - 1 THEN 'stop' END AS finish_reason
 FROM (SELECT stream_id, len(texts) AS n, unnest(range(len(texts))) AS seq, unnest(texts) AS content FROM cut))"""


def chunk_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, role, content, finish_reason) cut from the raw completions."""
    none = F.array(F.lit(None).cast("string"))
    texts = F.concat(none, F.regexp_extract_all("content", F.lit(PIECE), F.lit(0)), none)
    return (
        raw_completions(spark, sf_dir)
        .select("stream_id", texts.alias("texts"))
        .select("stream_id", F.size("texts").alias("n"), F.posexplode("texts").alias("seq", "content"))
        .select(
            "stream_id",
            F.col("seq").cast("long").alias("seq"),
            "content",
            F.when(F.col("seq") == 0, F.lit("assistant")).alias("role"),
            F.when(F.col("seq") == F.col("n") - 1, F.lit("stop")).alias("finish_reason"),
        )
    )


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, line): the chunks as whole JSON records, with fields that rewriting does not read."""
    first = F.struct(
        F.lit(0).alias("index"),
        F.struct("role", "content", F.when(F.col("seq") == 0, F.expr("array(named_struct('index', 0, 'name', 'native'))")).alias("tool_calls")).alias("delta"),
        F.when(F.col("seq") % 5 == 1, F.struct(F.array("seq").alias("tokens"))).alias("logprobs"),
        "finish_reason",
    )
    further = F.struct(F.lit(1).alias("index"), F.struct(F.concat(F.lit("alt "), F.col("seq")).alias("content")).alias("delta"))
    parts = F.array_compact(F.array(F.to_json(first), F.when(F.col("seq") % 7 == 3, F.to_json(further))))
    head = F.regexp_replace(F.to_json(F.struct(F.col("stream_id").alias("id"), "stream_id", "seq", (F.col("seq") + 1_700_000_000).alias("created"))), r"\}$", "")
    line = F.concat(head, F.lit(',"choices":['), F.array_join(parts, ","), F.lit("]}"))
    return chunk_streams(spark, sf_dir).select("stream_id", "seq", line.alias("line"))


# Spans, one per event.
_SPAN_NAME = """CASE WHEN event_id % 97 = 0 THEN 'http.request' WHEN event_id % 101 = 0 THEN 'slm.other'
 WHEN event_type = 'purchase' THEN 'slm.chat_completion.non_streaming'
 WHEN event_type = 'signup' THEN 'slm.embedding'
 WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'slm.chat_completion.non_streaming'
 WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'slm.embedding'
 ELSE 'slm.chat_completion.streaming' END"""
_SPAN_COLUMNS = {
    "span_id": "CAST(event_id AS {text})",
    "event_id": "event_id",
    "trace_id": "md5(CAST(user_id AS {text}))",
    "name": _SPAN_NAME,
    "start_ns": "start_ns",
    "end_ns": "CASE WHEN event_id % 53 = 0 THEN 0 ELSE start_ns + CAST(round(value * 1000) AS BIGINT) * 1000 END",
    "status_code": "CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 2 = 0 THEN 'OK' ELSE 'UNSET' END",
    "status_description": "CASE WHEN event_type = 'error' THEN concat('failure ', event_id % 7) END",
    "model": "CASE WHEN event_id % 41 <> 0 THEN concat('m', user_id % 3) END",
    "streaming": f"({_SPAN_NAME}) = 'slm.chat_completion.streaming'",
    "max_tokens": "CAST(event_id % 4 * 128 AS INT)",
    "temperature": "CAST(0.2 AS DOUBLE)",
    "input_messages": "CAST(1 + event_id % 6 AS INT)",
    "input_content_length": "event_id % 1000 * 3",
    "input_count": "CAST(event_id % 5 AS INT)",
    "prompt_tokens": "k",
    "completion_tokens": "event_id % 200",
    "total_tokens": "k + event_id % 200",
    "output_content_length": "event_id % 777",
    "chunk_count": "event_id % 9",
    "output_count": "CAST(event_id % 5 AS INT)",
    "force_sample": "event_type = 'error' AND event_id % 10 = 0",
}


def _span_columns(text: str) -> dict[str, str]:
    return {name: sql.replace("{text}", text) for name, sql in _SPAN_COLUMNS.items()}


SPANS_SQL = (
    "spans AS (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _span_columns("VARCHAR").items())
    + ", ts FROM (SELECT *, epoch_us(ts) * 1000 AS start_ns, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    # The table's times carry no zone; counting from the epoch keeps the session zone out.
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    named = _span_columns("STRING")
    return events.select(
        "event_id", "user_id", "event_type", "value", "ts",
        (micros * 1000).alias("start_ns"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    ).select(*[F.expr(sql).alias(name) for name, sql in named.items()], "ts")


_EVENT_COLUMNS = {
    "span_id": "span_id",
    "seq": "seq",
    "name": "CASE WHEN seq % 6 = 5 THEN 'other.event' ELSE 'slm.chunk_generated' END",
    "ts_ns": "start_ns + (seq + 1) * 20000000",
    "chunk_size": "90 + (event_id * 31 + seq * 17) % 23",
    "chunk_content_size": "CASE WHEN (event_id * 31 + seq * 17) % 4 = 0 THEN 0 ELSE (event_id * 31 + seq * 17) % 23 END",
}
SPAN_EVENTS_SQL = (
    f"{SPANS_SQL}, span_events AS (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _EVENT_COLUMNS.items())
    + " FROM (SELECT span_id, event_id, start_ns, unnest(range(event_id % 9)) AS seq FROM spans WHERE streaming))"
)


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        spans(spark, sf_dir)
        .where("streaming and event_id % 9 > 0")
        .select(
            "span_id", "event_id", "start_ns",
            F.explode(F.sequence(F.lit(0).cast("long"), F.expr("event_id % 9 - 1"))).alias("seq"),
        )
        .select(*[F.expr(sql).alias(name) for name, sql in _EVENT_COLUMNS.items()])
    )
