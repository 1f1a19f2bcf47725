"""Queries over chunk streams, recorded and live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import contracts, replay, usage
from parley.operators.requests import conversation_attributes
from parley.plans.completion_queries import id_sql
from parley.plans.derive import CHUNKS_SQL, SQL_TOKEN, STRICT_JSON, WS, chunk_lines, chunk_streams, table
from parley.plans.registry import query
from parley.session import shared_folder
from parley.sources import chunks as W
from parley.streaming.rewrite import as_chunks, rewrite_live

_TAG_LIST = "'<think>', '</think>', '<tool_call>', '</tool_call>'"

REPLAY_SQL = f"""{CHUNKS_SQL}, texts AS (
 SELECT stream_id, string_agg(content, '' ORDER BY seq) AS t FROM chunks WHERE length(content) > 0 GROUP BY stream_id),
toks AS (
 SELECT stream_id, unnest(range(len(l))) AS i, unnest(l) AS tok FROM (
  SELECT stream_id, regexp_extract_all(t, '{SQL_TOKEN}', 0) AS l FROM texts)),
placed AS (
 SELECT *, tok IN ({_TAG_LIST}) AS is_tag,
  sum(length(tok)) OVER (PARTITION BY stream_id ORDER BY i) AS chars,
  sum(CASE WHEN tok IN ({_TAG_LIST}) THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY i) AS segment FROM toks),
firsts AS (SELECT stream_id, 0 AS segment, NULL AS tag, '' AS tok, 0 AS chars, -1 AS i FROM texts),
segs AS (
 SELECT stream_id, segment, max(tag) AS tag, max(end_chars) AS end_chars, string_agg(tok, '' ORDER BY i) AS text FROM (
  SELECT stream_id, segment, CASE WHEN is_tag THEN tok END AS tag, CASE WHEN is_tag THEN '' ELSE tok END AS tok,
   CASE WHEN is_tag THEN chars END AS end_chars, i FROM placed
  UNION ALL SELECT stream_id, segment, tag, tok, chars, i FROM firsts) GROUP BY stream_id, segment),
told AS (
 SELECT stream_id, segment, tag, end_chars, CASE WHEN segment > 0 THEN ltrim(text, '{WS}') ELSE text END AS text,
  coalesce(tag = '</tool_call>' AND lag(tag) OVER (PARTITION BY stream_id ORDER BY segment) = '<tool_call>', false) AS closes FROM segs),
numbered AS (
 SELECT *, sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY segment) AS call_no,
  sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id) AS calls_total FROM told),
inner_text AS (
 SELECT stream_id, call_no, string_agg(text, '' ORDER BY segment) AS t FROM numbered WHERE tag = '<tool_call>' GROUP BY ALL),
closed AS (
 SELECT n.stream_id, n.segment, n.end_chars, n.call_no - 1 AS call_no, trim(coalesce(t, ''), '{WS}') AS body
 FROM numbered n LEFT JOIN inner_text x ON x.stream_id = n.stream_id AND x.call_no = n.call_no - 1 WHERE n.closes),
judged AS (
 SELECT *, {STRICT_JSON.format(b='body')} AS is_json,
  CASE WHEN {STRICT_JSON.format(b='body')} THEN CASE WHEN json_type(body) = 'OBJECT' THEN json_extract_string(body, '$.name') END END AS name FROM closed),
calls AS (
 SELECT *, name IS NOT NULL AS ok,
  sum(CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY call_no) - 1 AS call_index,
  CASE WHEN name IS NOT NULL THEN CASE WHEN json_extract(body, '$.arguments') IS NULL THEN '{{}}'
   WHEN json_type(body, '$.arguments') = 'VARCHAR' THEN json_extract_string(body, '$.arguments')
   ELSE CAST(json_extract(body, '$.arguments') AS VARCHAR) END END AS arguments FROM judged),
replayed AS (
 SELECT stream_id, segment, CASE WHEN tag = '<think>' THEN 'reasoning' ELSE 'content' END AS kind, text,
  NULL::BIGINT AS call_index, NULL AS name, NULL AS arguments
 FROM numbered WHERE coalesce(tag, '') <> '<tool_call>' AND length(text) > 0
 UNION ALL
 SELECT stream_id, segment, CASE WHEN ok THEN 'tool_call' WHEN is_json THEN 'error' ELSE 'content' END,
  CASE WHEN NOT ok THEN body END, CASE WHEN ok THEN call_index END, name, arguments
 FROM calls WHERE ok OR length(body) > 0)"""

_TOTALS = """SELECT stream_id, coalesce(sum(length(text)) FILTER (kind = 'content'), 0)::BIGINT AS content_chars,
 coalesce(sum(length(text)) FILTER (kind = 'reasoning'), 0)::BIGINT AS reasoning_chars,
 count(*) FILTER (kind = 'tool_call') AS tool_calls, count(*) FILTER (kind = 'error') AS bad_calls
 FROM replayed GROUP BY stream_id"""

#: Output rows of each chunk: characters by the chunk they stand in (pieces of seven), a token that begins with '<' by its last character.
OUTPUT_SQL = f"""{REPLAY_SQL}, sized AS (SELECT stream_id, max(seq) AS last_seq FROM chunks GROUP BY stream_id),
units AS (
 SELECT stream_id, i, segment, tok, chars - length(tok) AS start, chars AS stop, starts_with(tok, '<') AS opens,
  i = max(i) OVER (PARTITION BY stream_id) AND (starts_with('<think>', tok) OR starts_with('</think>', tok) OR starts_with('<tool_call>', tok)
   OR starts_with('</tool_call>', tok)) AS held FROM placed WHERE NOT is_tag),
letters AS (
 SELECT *, CASE WHEN opens THEN tok ELSE substr(tok, (pos - start)::BIGINT, 1) END AS ch FROM (
  SELECT *, unnest(CASE WHEN opens THEN [stop] ELSE range((start + 1)::BIGINT, (stop + 1)::BIGINT) END) AS pos FROM units)),
seen AS (
 SELECT l.*, s.tag, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY l.stream_id, l.segment ORDER BY pos) AS row_no,
  l.segment = 0 OR bool_or(length(trim(ch, '{WS}')) > 0) OVER (PARTITION BY l.stream_id, l.segment ORDER BY pos) AS shown,
  CASE WHEN held THEN z.last_seq + 1 ELSE (pos - 1) // 7 + 1 END AS seq
 FROM letters l JOIN segs s ON s.stream_id = l.stream_id AND s.segment = l.segment JOIN sized z ON z.stream_id = l.stream_id),
out_rows AS (
 SELECT stream_id, seq::BIGINT AS seq, min(pos) AS pos, CASE WHEN any_value(tag) = '<think>' THEN 'reasoning' ELSE 'content' END AS kind,
  string_agg(ch, '' ORDER BY pos) AS text, NULL::BIGINT AS call_index, NULL AS name, NULL AS arguments
 FROM seen WHERE shown AND coalesce(tag, '') <> '<tool_call>' GROUP BY stream_id, seq, segment, row_no
 UNION ALL SELECT stream_id, (end_chars - 1) // 7 + 1, end_chars, CASE WHEN ok THEN 'tool_call' WHEN is_json THEN 'error' ELSE 'content' END,
  CASE WHEN NOT ok THEN body END, CASE WHEN ok THEN call_index END, name, arguments FROM calls WHERE ok OR length(body) > 0
 UNION ALL SELECT stream_id, seq, 0, 'passthrough', NULL, NULL, NULL, NULL FROM chunks WHERE content IS NULL),
outputs AS (
 SELECT o.stream_id, o.seq, (row_number() OVER (PARTITION BY o.stream_id, o.seq ORDER BY pos) - 1)::INTEGER AS part, kind, text,
  CASE WHEN kind <> 'tool_call' THEN c.role END AS role,
  CASE WHEN c.finish_reason IS NOT NULL THEN CASE WHEN o.stream_id IN (SELECT stream_id FROM calls WHERE ok) THEN 'tool_calls' ELSE 'stop' END END AS finish_reason,
  o.call_index::BIGINT AS call_index, o.name, o.arguments, CASE WHEN kind IN ('content', 'error') THEN text END AS content
 FROM out_rows o LEFT JOIN chunks c ON c.stream_id = o.stream_id AND c.seq = o.seq)"""


@query("replay_output_chunks", f"WITH {OUTPUT_SQL} SELECT * EXCLUDE (content) FROM outputs")
def replay_output_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.output_chunks(chunk_streams(spark, sf_dir))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.as_spoken(replay.output_chunks(chunk_streams(spark, sf_dir)))


@query(
    "stream_replay",
    f"""WITH {REPLAY_SQL} SELECT stream_id, segment::BIGINT AS segment, kind, text, call_index::BIGINT AS call_index, name, arguments FROM replayed""",
)
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replay_streams(chunk_streams(spark, sf_dir)).drop("part", "call_id")


@query("stream_replay_totals", f"WITH {REPLAY_SQL} {_TOTALS}")
def stream_replay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.stream_totals(replay.replay_streams(chunk_streams(spark, sf_dir)))


@query(
    "stream_tool_calls",
    f"""WITH {REPLAY_SQL} SELECT stream_id, call_index::BIGINT AS call_index, {id_sql('call', 'stream_id', 'call_index')} AS call_id,
     name, arguments FROM replayed WHERE kind = 'tool_call'""",
)
def stream_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        replay.stream_calls(chunk_streams(spark, sf_dir))
        .where("kind = 'tool_call'")
        .select("stream_id", "call_index", "call_id", "name", "arguments")
    )


@query(
    "finish_reason_propagation",
    f"""WITH {REPLAY_SQL}, ends AS (
      SELECT stream_id, seq, sum(length(coalesce(content, ''))) OVER (PARTITION BY stream_id ORDER BY seq) AS chars, finish_reason FROM chunks),
     first_call AS (SELECT stream_id, min(end_chars) AS at FROM calls WHERE ok GROUP BY stream_id)
     SELECT e.stream_id, e.seq, CASE WHEN f.at <= e.chars THEN 'tool_calls' ELSE e.finish_reason END AS finish_reason
     FROM ends e LEFT JOIN first_call f USING (stream_id) WHERE e.finish_reason IS NOT NULL""",
)
def finish_reason_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.finish_reasons(chunk_streams(spark, sf_dir))


@query(
    "stream_flush",
    f"""WITH {REPLAY_SQL}, ends AS (
      SELECT stream_id, arg_max(tok, i) AS tok,
       coalesce(arg_max(tok, i) FILTER (tok IN ('<think>', '</think>', '<tool_call>', '</tool_call>')), '') AS opened FROM toks GROUP BY stream_id)
     SELECT stream_id, tok AS flushed, CASE WHEN opened = '<think>' THEN 'reasoning' ELSE 'content' END AS kind FROM ends
     WHERE opened <> '<tool_call>' AND (starts_with('<think>', tok) OR starts_with('</think>', tok) OR starts_with('<tool_call>', tok)
      OR starts_with('</tool_call>', tok)) AND tok NOT IN ('<think>', '</think>', '<tool_call>', '</tool_call>')""",
)
def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.held_tails(chunk_streams(spark, sf_dir))


@query(
    "dropped_call_tails",
    f"""WITH {REPLAY_SQL} SELECT stream_id, sum(length(text))::BIGINT AS dropped_tail FROM numbered
     WHERE tag = '<tool_call>' AND length(text) > 0 AND call_no >= calls_total GROUP BY stream_id""",
)
def dropped_call_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.lost_tails(chunk_streams(spark, sf_dir))


@query(
    "leading_whitespace",
    f"""WITH {REPLAY_SQL} SELECT stream_id, count(*) AS stretches, count(*) FILTER (segment > 0 AND ltrim(text, '{WS}') <> text) AS unstripped,
     sum(length(text))::BIGINT AS chars FROM replayed WHERE kind IN ('content', 'reasoning') GROUP BY stream_id""",
)
def leading_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions.text import lstrip

    said = replay.replay_streams(chunk_streams(spark, sf_dir)).where("kind in ('content', 'reasoning')")
    return said.groupBy("stream_id").agg(
        F.count("*").alias("stretches"),
        F.count_if((F.col("segment") > 0) & (lstrip(F.col("text")) != F.col("text"))).alias("unstripped"),
        F.sum(F.length("text")).alias("chars"),
    )


@query(
    "passthrough_chunks",
    f"""WITH {CHUNKS_SQL} SELECT stream_id, seq, role, finish_reason FROM chunks
     WHERE content IS NULL OR (content = '' AND length(finish_reason) > 0)""",
)
def passthrough_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.passthrough_chunks(chunk_streams(spark, sf_dir)).drop("content")


@query(
    "stream_ids",
    f"""WITH {CHUNKS_SQL} SELECT stream_id, {id_sql('chatcmpl', 'stream_id')} AS id, 'served' AS model, count(*) AS chunks
     FROM chunks GROUP BY stream_id""",
)
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = replay.stamp_streams(chunk_streams(spark, sf_dir).withColumn("model", F.lit("base")), "served")
    return stamped.groupBy("stream_id", "id", "model").agg(F.count("*").alias("chunks"))


@query(
    "stream_usage",
    f"""WITH {OUTPUT_SQL} SELECT stream_id, count(*) FILTER (length(content) > 0) AS completion_tokens,
     sum(length(coalesce(content, '')))::BIGINT AS output_content_length, count(*) FILTER (length(content) > 0) AS chunk_count,
     count(*) FILTER (kind = 'reasoning') AS reasoning_chunks, count(*) AS chunk_events,
     any_value(p.prompt_tokens) AS prompt_tokens, any_value(p.prompt_tokens) + count(*) FILTER (length(content) > 0) AS total_tokens
     FROM outputs JOIN (SELECT conv_id, greatest(1, CAST(floor(sum(length(text)) / 4.0) AS BIGINT)) AS prompt_tokens FROM conversations GROUP BY conv_id) p
     ON p.conv_id = CAST(string_split(stream_id, '-')[1] AS BIGINT) GROUP BY stream_id""",
)
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = conversation_attributes(table(spark, sf_dir, "conversations")).select("conv_id", "prompt_tokens")
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        "conv_id", F.expr("concat(conv_id, '-', turn)").alias("stream_id")
    )
    estimates = turns.join(prompts, "conv_id").select("stream_id", "prompt_tokens")
    return usage.stream_usage(_spoken(spark, sf_dir), estimates)


@query(
    "running_usage",
    f"""WITH {OUTPUT_SQL}, each AS (SELECT stream_id, seq, count(*) FILTER (length(content) > 0) AS n, sum(length(coalesce(content, ''))) AS c
      FROM outputs GROUP BY stream_id, seq)
     SELECT stream_id, seq, sum(n) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS completion_tokens,
     sum(c) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS output_content_length FROM each""",
)
def running_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.running_usage(_spoken(spark, sf_dir)).select(
        "stream_id", "seq", "completion_tokens", "output_content_length"
    )


@query(
    "chunk_event_rows",
    f"""WITH {OUTPUT_SQL} SELECT stream_id AS span_id, seq, 'slm.chunk_generated' AS name, seq * 20000000 AS ts_ns,
     length(coalesce(content, '')) + 90 AS chunk_size, length(coalesce(content, '')) AS chunk_content_size, finish_reason FROM outputs""",
)
def chunk_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.length(F.coalesce("content", F.lit(""))) + 90).cast("long")
    return usage.chunk_events(_spoken(spark, sf_dir), F.col("stream_id"), F.col("seq") * 20_000_000, size)


@query(
    "chunk_wire_size",
    f"""WITH {CHUNKS_SQL} SELECT stream_id, seq, length(concat('{{"stream_id":"', stream_id, '","seq":', seq,
      CASE WHEN content IS NOT NULL THEN concat(',"content":', to_json(content)) ELSE '' END, '}}')) AS wire_size FROM chunks""",
)
def chunk_wire_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_streams(spark, sf_dir).select(
        "stream_id", "seq", usage.wire_size(F.struct("stream_id", "seq", "content")).alias("wire_size")
    )


@query(
    "stream_contract",
    f"""WITH {REPLAY_SQL} SELECT stream_id, bool_or(contains(coalesce(text, ''), '<tool_call>') OR contains(coalesce(text, ''), '</tool_call>')) AS raw_call_tag,
     bool_or(kind IN ('content', 'tool_call')) AS has_output FROM replayed GROUP BY stream_id""",
)
def stream_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.check_streams(replay.replay_streams(chunk_streams(spark, sf_dir)))


@query(
    "streams_without_finish",
    f"""WITH {CHUNKS_SQL}, seen AS (SELECT * FROM chunks WHERE NOT (finish_reason IS NOT NULL AND stream_id LIKE '%3'))
     SELECT stream_id, count(*) AS chunks FROM seen GROUP BY stream_id HAVING count(finish_reason) = 0""",
)
def streams_without_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Streams ending in 3 lose their finishing chunk here.
    seen = chunk_streams(spark, sf_dir).where("not (finish_reason is not null and stream_id like '%3')")
    return (
        seen.groupBy("stream_id")
        .agg(F.count("*").alias("chunks"), F.count("finish_reason").alias("finished"))
        .where("finished = 0")
        .drop("finished")
    )


_PAYLOAD = """concat('{"seq":', seq, CASE WHEN content IS NOT NULL THEN concat(',"content":', to_json(content)) ELSE '' END,
 CASE WHEN finish_reason IS NOT NULL THEN concat(',"finish_reason":', to_json(finish_reason)) ELSE '' END, '}')"""


@query(
    "event_stream_encode",
    f"""WITH {CHUNKS_SQL} SELECT stream_id, seq, concat('data: ', {_PAYLOAD}) AS event FROM chunks
     UNION ALL SELECT stream_id, max(seq) + 1, 'data: [DONE]' FROM chunks GROUP BY stream_id""",
)
def event_stream_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.encode_events(chunk_streams(spark, sf_dir), F.to_json(F.struct("seq", "content", "finish_reason")))


@query(
    "event_stream_decode",
    f"""WITH {CHUNKS_SQL} SELECT stream_id, seq, CASE WHEN seq % 50 <> 49 THEN content END AS content,
     CASE WHEN seq % 50 <> 49 THEN finish_reason END AS finish_reason, seq % 50 = 49 AS unreadable FROM chunks""",
)
def event_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_streams(spark, sf_dir)
    choice = F.struct(
        F.lit(0).alias("index"),
        F.struct("role", "content").alias("delta"),
        "finish_reason",
    )
    whole = F.to_json(F.struct(F.array(choice).alias("choices")))
    # Every fiftieth event is cut off.
    payload = F.when(F.col("seq") % 50 == 49, F.lit('{"choices": [')).otherwise(whole)
    decoded = W.decode_events(W.encode_events(chunks, payload))
    delta = F.get("choices", F.lit(0))
    return decoded.select(
        "stream_id",
        "seq",
        delta["delta"]["content"].alias("content"),
        delta["finish_reason"].alias("finish_reason"),
        F.col("_corrupt").isNotNull().alias("unreadable"),
    )


#: Output rows with what rewriting does not read: it comes from the chunk, for what an ended stream still held from the last one.
WHOLE_SQL = f"""WITH {OUTPUT_SQL} SELECT o.stream_id, o.seq, part, kind, o.text, o.role, o.finish_reason, call_index, o.name, 1700000000 + from_seq AS created,
 CASE WHEN from_seq % 5 = 1 THEN concat('{{"tokens":[', from_seq, ']}}') END AS logprobs, CASE WHEN from_seq % 7 = 3 THEN concat('alt ', from_seq) END AS further,
 CASE WHEN kind = 'passthrough' AND from_seq = 0 THEN 'native' END AS native_call
 FROM (SELECT o.*, least(o.seq, z.last_seq) AS from_seq FROM outputs o JOIN sized z ON z.stream_id = o.stream_id) o"""


def _whole(outputs: DataFrame) -> list:
    return [
        F.try_variant_get("rest", "$.created", "bigint").alias("created"), F.to_json(F.try_variant_get("rest", "$.choice.logprobs", "variant")).alias("logprobs"),
        F.try_variant_get("rest", "$.more[0].delta.content", "string").alias("further"), F.try_variant_get("delta_rest", "$.tool_calls[0].name", "string").alias("native_call"),
    ]


@query("replay_whole_deltas", WHOLE_SQL)
def replay_whole_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chunk_lines(spark, sf_dir).select("stream_id", "seq", F.parse_json("line").alias("record"))
    out = replay.output_chunks(W.flat_chunks(records).drop("done"))
    return out.select("stream_id", "seq", "part", "kind", "text", "role", "finish_reason", "call_index", "name", *_whole(out))


@query("live_chunk_folder", WHOLE_SQL)
def live_chunk_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records dealt over files with no regard to streams, taken in several micro-batches; the finishing chunk ends its stream."""
    folder = shared_folder(spark, "live-folder")
    lines = chunk_lines(spark, sf_dir).repartition(12, F.xxhash64("stream_id", "seq"))
    lines.select(F.col("line").alias("value")).write.text(f"{folder}/in")
    flat = W.flat_chunks(W.chunk_records(spark, f"{folder}/in", live=True, files_per_batch=5))
    out = _with_part(_finish_live(spark, flat, folder))
    text = F.when(F.col("kind") == "reasoning", F.col("reasoning_content")).otherwise(F.col("content"))
    return out.select("stream_id", "seq", "part", "kind", text.alias("text"), "role", "finish_reason", "call_index", F.col("call_name").alias("name"), *_whole(out))


@query("event_files_replay", f"WITH {OUTPUT_SQL} SELECT * EXCLUDE (content) FROM outputs")
def event_files_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams written as event files, cut anywhere, and read back: the files alone tell stream and order."""
    folder = shared_folder(spark, "events")
    lines = chunk_lines(spark, sf_dir)
    W.write_events(W.encode_events(lines.select("stream_id", "seq", "line"), F.col("line")), folder, 6)
    read = W.read_events(spark, folder)
    return replay.output_chunks(W.flat_chunks(read.where("not done")).drop("done", "rest", "delta_rest"))


def _run_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the chunks to a folder, rewrite them as a stream until all are done, read the result."""
    folder = shared_folder(spark, "live")
    chunks = chunk_streams(spark, sf_dir).withColumns({"has_delta": F.lit(True), "done": F.lit(False)})
    ends = (
        chunks.groupBy("stream_id")
        .agg((F.max("seq") + 1).alias("seq"))
        .withColumns(
            {
                "content": F.lit(None).cast("string"),
                "role": F.lit(None).cast("string"),
                "finish_reason": F.lit(None).cast("string"),
                "has_delta": F.lit(True),
                "done": F.lit(True),
            }
        )
    )
    chunks.unionByName(ends).write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/in")
    return _finish_live(spark, live, folder)


def _finish_live(spark: SparkSession, live: DataFrame, folder: str) -> DataFrame:
    """Rewrite all that there is, and read the result."""
    rewritten = rewrite_live(live, gap_ms=None, idle_ms=None, keep_ms=None)
    run = (
        rewritten.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(rewritten.schema).parquet(f"{folder}/out")


@query(
    "live_stream_rewrite",
    f"""WITH {REPLAY_SQL} SELECT stream_id, totals.content_chars, totals.reasoning_chars, totals.tool_calls, totals.bad_calls
     FROM ({_TOTALS}) AS totals""",
)
def live_stream_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run_live(spark, sf_dir).withColumn("text", F.coalesce("content", "reasoning_content"))
    return replay.stream_totals(out.where("kind <> 'passthrough'"))


@query(
    "live_running_counters",
    f"""WITH {OUTPUT_SQL} SELECT stream_id, seq, part, count(*) FILTER (length(content) > 0) OVER so_far AS completion_tokens,
     coalesce(sum(length(content)) OVER so_far, 0)::BIGINT AS output_length
     FROM outputs WINDOW so_far AS (PARTITION BY stream_id ORDER BY seq, part)""",
)
def live_running_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_part(_run_live(spark, sf_dir)).select("stream_id", "seq", "part", "completion_tokens", "output_length")


def _with_part(live: DataFrame) -> DataFrame:
    """Number the outputs of each chunk, as the recorded replay does."""
    return live.withColumn("part", F.row_number().over(Window.partitionBy("stream_id", "seq").orderBy("out_no")) - 1)


@query(
    "live_roles_and_finish",
    f"""WITH {REPLAY_SQL}, any_call AS (SELECT DISTINCT stream_id FROM calls WHERE ok)
     SELECT stream_id, 'assistant' AS role, CASE WHEN a.stream_id IS NOT NULL THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
      {id_sql('chatcmpl', 'c.stream_id')} AS id
     FROM chunks c LEFT JOIN any_call a USING (stream_id) WHERE seq = 0""",
)
def live_roles_and_finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = as_chunks(_run_live(spark, sf_dir), F.lit(0), F.lit("served"))
    first = F.get("choices", F.lit(0))
    return nested.groupBy("stream_id", "id").agg(
        F.max(first["delta"]["role"]).alias("role"), F.max(first["finish_reason"]).alias("finish_reason")
    )
