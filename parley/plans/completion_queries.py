"""Queries over raw completions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.constants import TAGS
from parley.functions import tags as T
from parley.functions import text as X
from parley.functions.ids import stable_id
from parley.operators import completions as C
from parley.operators import contracts
from parley.operators.inference import echo_backend, generate_completions
from parley.plans.derive import RAW_SQL, SQL_CALL, SQL_SPACE, SQL_THINK, SQL_TOKEN, STRICT_JSON, WS, raw_completions, table
from parley.plans.registry import query

_CLEAN = f"""CASE WHEN len(thoughts) = 0 THEN content
 ELSE trim(regexp_replace(content, '{SQL_THINK}', '', 'g'), '{WS}') END"""
_REASONING = f"""nullif(array_to_string(list_transform(thoughts, lambda x: trim(x, '{WS}')), chr(10)), '')"""

SPLIT_SQL = f"""{RAW_SQL}, thought AS (
 SELECT *, regexp_extract_all(content, '{SQL_THINK}', 1) AS thoughts FROM raw),
split AS (SELECT conv_id, turn, stream_id, content AS raw_content, {_REASONING} AS reasoning, {_CLEAN} AS content FROM thought)"""


def calls_sql(source: str) -> str:
    """CTEs that parse the calls in ``source.content`` into ``parsed``."""
    return f"""bodies AS (
 SELECT stream_id, unnest(range(len(l))) AS i, unnest(l) AS body FROM (
  SELECT stream_id, regexp_extract_all(content, '{SQL_CALL}', 1) AS l FROM {source})),
kinds AS (
 SELECT *, CASE WHEN {STRICT_JSON.format(b='body')} THEN json_type(body) = 'OBJECT' ELSE false END AS is_object FROM bodies),
records AS (
 SELECT stream_id, i,
  CASE WHEN is_object THEN json_extract_string(body, '$.name') END AS name,
  CASE WHEN is_object THEN CASE WHEN json_extract(body, '$.arguments') IS NULL THEN '{{}}'
   WHEN json_type(body, '$.arguments') = 'VARCHAR' THEN json_extract_string(body, '$.arguments')
   ELSE CAST(json_extract(body, '$.arguments') AS VARCHAR) END END AS arguments
 FROM kinds),
called AS (
 SELECT stream_id, count(*) AS n, bool_or(name IS NULL) AS bad,
  string_agg(name, '|' ORDER BY i) AS names, string_agg(arguments, '|' ORDER BY i) AS arguments,
  string_agg(concat(stream_id, '|', i), ',' ORDER BY i) AS call_keys
 FROM records GROUP BY stream_id),
parsed AS (
 SELECT s.*, coalesce(bad, false) AS parse_error,
  CASE WHEN n > 0 AND NOT bad THEN n ELSE 0 END AS n_calls,
  CASE WHEN n > 0 AND NOT bad THEN names ELSE '' END AS names,
  CASE WHEN n > 0 AND NOT bad THEN arguments ELSE '' END AS arguments,
  CASE WHEN n > 0 AND NOT bad THEN nullif(trim(regexp_replace(content, '{SQL_CALL}', '', 'g'), '{WS}'), '') ELSE content END AS remaining
 FROM {source} AS s LEFT JOIN called USING (stream_id))"""


REWRITE_SQL = f"""{SPLIT_SQL}, {calls_sql('split')}, rewritten AS (
 SELECT conv_id, turn, stream_id, raw_content,
  CASE WHEN parse_error THEN raw_content ELSE remaining END AS content,
  CASE WHEN NOT parse_error THEN reasoning END AS reasoning,
  n_calls, names, arguments, parse_error,
  CASE WHEN n_calls > 0 THEN 'tool_calls' ELSE 'stop' END AS finish_reason FROM parsed)"""


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_completions(spark, sf_dir).withColumn("finish_reason", F.lit("stop"))
    return C.rewrite_texts(raw, key=("stream_id",))


def _joined(field: str):
    return F.array_join(F.transform("tool_calls", lambda c: c["function"][field]), "|")


@query(
    "rewrite_report",
    f"""WITH {REWRITE_SQL}
    SELECT finish_reason, parse_error, count(*) AS answers, sum(n_calls)::BIGINT AS calls,
     sum(length(coalesce(content, '')))::BIGINT AS content_chars,
     sum(length(coalesce(reasoning, '')))::BIGINT AS reasoning_chars,
     count(*) FILTER (content IS NULL) AS no_content
    FROM rewritten GROUP BY finish_reason, parse_error""",
)
def rewrite_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).groupBy("finish_reason", "parse_error").agg(
        F.count("*").alias("answers"),
        F.sum(F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).otherwise(0)).alias("calls"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("content_chars"),
        F.sum(F.length(F.coalesce("reasoning", F.lit("")))).alias("reasoning_chars"),
        F.count_if(F.col("content").isNull()).alias("no_content"),
    )


@query("reasoning_split", f"WITH {SPLIT_SQL} SELECT conv_id, turn, reasoning, content FROM split")
def reasoning_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_completions(spark, sf_dir).select(
        "conv_id", "turn", T.split_reasoning(F.col("content")).alias("s")
    ).select("conv_id", "turn", "s.*")


@query(
    "tool_call_parse",
    f"""WITH {RAW_SQL}, {calls_sql('raw')}
    SELECT conv_id, turn, n_calls::BIGINT AS n_calls, names, arguments, remaining, parse_error FROM parsed""",
)
def tool_call_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = raw_completions(spark, sf_dir).withColumn("p", T.parse_calls(F.col("content")))
    return parsed.select(
        "conv_id",
        "turn",
        F.size("p.calls").cast("long").alias("n_calls"),
        F.array_join(F.transform("p.calls", lambda c: c["name"]), "|").alias("names"),
        F.array_join(F.transform("p.calls", lambda c: c["arguments"]), "|").alias("arguments"),
        "p.remaining",
        "p.parse_error",
    )


# Call bodies with every kind of arguments.
_BODY = """CASE event_id % 8
 WHEN 0 THEN concat('{"name": "f", "arguments": ', props, '}')
 WHEN 1 THEN '{"name": "f"}'
 WHEN 2 THEN '{"name": "f", "arguments": null}'
 WHEN 3 THEN '{"name": "f", "arguments": "as it is"}'
 WHEN 4 THEN '{"name": "f", "arguments": [1, "two", {"three": 3}]}'
 WHEN 5 THEN '{"arguments": 5}'
 WHEN 6 THEN '[1]'
 ELSE CASE event_id % 5 WHEN 0 THEN '{"name": "f"} x' WHEN 1 THEN '{"name": "f"}] x' WHEN 2 THEN '{"name": "f"}} x'
  WHEN 3 THEN '{"name": "f"} {"name": "g"}' ELSE '{"name": "f", "a": NaN}' END END"""


@query(
    "tool_argument_text",
    f"""SELECT event_id, CASE WHEN event_id % 8 < 5 THEN 'f' END AS name, CASE event_id % 8
      WHEN 0 THEN CAST(json_extract(props, '$') AS VARCHAR) WHEN 1 THEN '{{}}' WHEN 2 THEN 'null' WHEN 3 THEN 'as it is'
      WHEN 4 THEN '[1,"two",{{"three":3}}]' END AS arguments,
     {STRICT_JSON.format(b='(' + _BODY + ')')} AS is_json, event_id % 8 < 5 AS ok FROM events""",
)
def tool_argument_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "events").select("event_id", F.expr(_BODY).alias("body"))
    return bodies.select("event_id", T.call_record(F.col("body")).alias("c")).select("event_id", "c.*")


@query(
    "completion_rewrite",
    f"""WITH {REWRITE_SQL}
    SELECT conv_id, turn, content, reasoning, n_calls::BIGINT AS n_calls, nullif(names, '') AS names,
     nullif(arguments, '') AS arguments, finish_reason, parse_error FROM rewritten""",
)
def completion_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select(
        "conv_id",
        "turn",
        "content",
        "reasoning",
        F.when(F.col("tool_calls").isNotNull(), F.size("tool_calls")).otherwise(0).cast("long").alias("n_calls"),
        _joined("name").alias("names"),
        _joined("arguments").alias("arguments"),
        "finish_reason",
        "parse_error",
    )


def nested_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two choices per completion; the second is plain. Some have no usage, one in eleven no choices."""
    message = "named_struct('role', 'assistant', 'content', {c}, 'reasoning_content', string(null), 'tool_calls', cast(null as array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>))"
    choice = "named_struct('index', {i}, 'message', {m}, 'logprobs', string(null), 'finish_reason', 'stop')"
    choices = "CASE WHEN (conv_id + turn) % 11 <> 0 THEN array({a}, {b}) ELSE slice(array({a}), 1, 0) END".format(
        a=choice.format(i=0, m=message.format(c="content")), b=choice.format(i=1, m=message.format(c="'second'"))
    )
    usage = "CASE WHEN conv_id % 7 <> 0 THEN named_struct('prompt_tokens', conv_id, 'completion_tokens', CASE WHEN turn > 1 THEN turn END, 'total_tokens', conv_id + turn) END"
    return raw_completions(spark, sf_dir).select(
        F.col("stream_id").alias("id"),
        F.lit("chat.completion").alias("object"),
        F.col("conv_id").alias("created"),
        F.lit("base").alias("model"),
        F.expr(choices).alias("choices"),
        F.expr(usage).alias("usage"),
    )


_ID_SQL = "concat('{prefix}_', lpad(to_base(CAST(concat('0x', substr(sha256({key}), 1, 12)) AS BIGINT), 36), 10, '0'), lpad(to_base(CAST(concat('0x', substr(sha256({key}), 13, 12)) AS BIGINT), 36), 10, '0'))"


def id_sql(prefix: str, *keys: str) -> str:
    """The key of an id is each value with its length in front, ``~`` for null."""
    parts = [f"coalesce(length(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR), '~')" for k in keys]
    return _ID_SQL.replace("{prefix}", prefix).replace("{key}", " || ".join(parts))


@query(
    "nested_completion_rewrite",
    f"""WITH {REWRITE_SQL}
    SELECT {id_sql('chatcmpl', 'stream_id')} AS id, CASE WHEN conv_id % 2 = 0 THEN 'served' ELSE 'base' END AS model,
     CASE WHEN (conv_id + turn) % 11 = 0 THEN 0 ELSE 2 END::BIGINT AS n_choices,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN content END AS content,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN reasoning END AS reasoning,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN nullif(names, '') END AS names,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN finish_reason END AS finish_reason,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN 'second' END AS second FROM rewritten""",
)
def nested_completion_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = nested_completions(spark, sf_dir)
    even = C.rewrite_completions(nested.where("created % 2 = 0"), "served")
    odd = C.rewrite_completions(nested.where("created % 2 <> 0"))
    first, second = F.get("choices", F.lit(0)), F.get("choices", F.lit(1))
    return even.unionByName(odd).select(
        "id",
        "model",
        F.size("choices").cast("long").alias("n_choices"),
        first["message"]["content"].alias("content"),
        first["message"]["reasoning_content"].alias("reasoning"),
        F.array_join(F.transform(first["message"]["tool_calls"], lambda c: c["function"]["name"]), "|").alias("names"),
        first["finish_reason"].alias("finish_reason"),
        second["message"]["content"].alias("second"),
    )


@query(
    "completion_usage",
    f"""WITH {REWRITE_SQL}
    SELECT stream_id AS source, CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS prompt_tokens,
     CASE WHEN conv_id % 7 <> 0 THEN CASE WHEN turn > 1 THEN turn ELSE 0 END END AS completion_tokens,
     CASE WHEN conv_id % 7 <> 0 THEN conv_id + turn END AS total_tokens,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN length(coalesce(content, '')) END AS output_content_length,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN finish_reason END AS finish_reason FROM rewritten""",
)
def completion_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Usage is told of what the client gets, so the rewriting comes first.
    raw = nested_completions(spark, sf_dir).withColumn("source", F.col("id"))
    return C.completion_usage(C.rewrite_completions(raw), "source").drop("id")


@query(
    "first_choice_projection",
    f"""WITH {RAW_SQL}
    SELECT stream_id AS id, CASE WHEN (conv_id + turn) % 11 <> 0 THEN 'assistant' END AS role,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN content END AS content,
     CASE WHEN (conv_id + turn) % 11 <> 0 THEN 'stop' END AS finish_reason FROM raw""",
)
def first_choice_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = F.col("choices")
    return nested_completions(spark, sf_dir).select(
        "id",
        C.first_choice(choices, "message", "role").alias("role"),
        C.first_choice(choices, "message", "content").alias("content"),
        C.first_choice(choices, "finish_reason").alias("finish_reason"),
    )


@query(
    "completion_conformance",
    f"""WITH {RAW_SQL}
    SELECT stream_id AS id, content, CASE WHEN conv_id % 2 = 1 AND turn % 3 = 0 THEN concat('r', turn) END AS reasoning,
     CASE WHEN conv_id % 2 = 1 AND turn % 4 = 1 THEN 'f' END AS call_name, CASE WHEN conv_id % 2 = 1 AND turn % 5 < 2 THEN concat('{{"top":[', turn, ']}}') END AS logprobs,
     CASE WHEN conv_id % 2 = 1 AND turn % 2 = 0 THEN turn END AS prompt_tokens, CASE WHEN conv_id % 2 = 1 AND turn % 2 = 0 THEN 7 END AS total_tokens,
     CASE WHEN conv_id % 2 = 1 THEN conv_id END AS created FROM raw""",
)
def completion_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One table lacks all that is optional; the other has it in another order and other types, and a field too many.
    raw = raw_completions(spark, sf_dir).withColumn("id", F.col("stream_id"))
    sparse = raw.where("conv_id % 2 = 0").select(
        "id", F.expr("array(named_struct('index', 0, 'message', named_struct('role', 'assistant', 'content', content)))").alias("choices")
    )
    full = raw.where("conv_id % 2 = 1").select(
        F.expr("if(turn % 2 = 0, named_struct('total_tokens', 7, 'prompt_tokens', cast(turn as int)), null)").alias("usage"),
        F.expr(
            """array(named_struct('logprobs', if(turn % 5 < 2, named_struct('top', array(turn)), null), 'extra', 1,
             'message', named_struct('content', content, 'reasoning_content', if(turn % 3 = 0, concat('r', turn), null), 'role', 'assistant',
              'tool_calls', if(turn % 4 = 1, array(named_struct('type', 'function', 'id', 'c', 'function', named_struct('arguments', '{}', 'name', 'f'))), null)),
             'index', 0L))"""
        ).alias("choices"),
        F.col("conv_id").cast("int").alias("created"), "id", F.lit("x").alias("unknown"),
    )
    choices = F.col("choices")
    return C.conform_completions(sparse).unionByName(C.conform_completions(full)).select(
        "id",
        C.first_choice(choices, "message", "content").alias("content"),
        C.first_choice(choices, "message", "reasoning_content").alias("reasoning"),
        F.get(C.first_choice(choices, "message", "tool_calls"), F.lit(0))["function"]["name"].alias("call_name"),
        C.first_choice(choices, "logprobs").alias("logprobs"),
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.total_tokens").alias("total_tokens"),
        "created",
    )


@query(
    "model_override",
    f"""WITH {RAW_SQL} SELECT stream_id, 'served' AS given, concat('m', conv_id % 3) AS empty, concat('m', conv_id % 3) AS missing FROM raw""",
)
def model_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.expr("concat('m', conv_id % 3)")
    return raw_completions(spark, sf_dir).select(
        "stream_id",
        C.model_or("served", model).alias("given"),
        C.model_or("", model).alias("empty"),
        C.model_or(None, model).alias("missing"),
    )


@query(
    "response_ids",
    f"SELECT conv_id, turn, {id_sql('chatcmpl', 'conv_id', 'turn')} AS id FROM conversations",
)
def response_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", stable_id("chatcmpl", F.col("conv_id"), F.col("turn")).alias("id")
    )


# Pages whose paragraphs became reasoning: real text full of '<'.
_SOUP = "replace(replace(html, '<p>', '<think>'), '</p>', '</think>')"


@query(
    "tag_scan",
    f"""SELECT page_id, pos::BIGINT AS pos, token, token IN ('<think>', '</think>', '<tool_call>', '</tool_call>') AS is_tag FROM (
      SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS token FROM (
       SELECT page_id, regexp_extract_all({_SOUP}, '{SQL_TOKEN}', 0) AS l FROM pages))""",
)
def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(T.scan_tokens(F.expr(_SOUP))).alias("pos", "token")
    )
    return tokens.select("page_id", F.col("pos").cast("long").alias("pos"), "token", T.is_tag(F.col("token")).alias("is_tag"))


_PADDED = "concat(chr(160), chr(9), CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END, chr(8195), chr(12288), chr(10))"


@query(
    "unicode_strip",
    f"""SELECT doc_id, trim(p, '{WS}') AS stripped, ltrim(p, '{WS}') AS left_stripped FROM (SELECT doc_id, {_PADDED} AS p FROM documents)""",
)
def unicode_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # chr() of Spark only goes to 255, so the wide blanks are literals here.
    padded = _PADDED.replace("chr(8195)", "' '").replace("chr(12288)", "'　'")
    p = F.expr(padded)
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.strip(p).alias("stripped"), X.lstrip(p).alias("left_stripped")
    )


@query(
    "log_rounding",
    "SELECT l_orderkey, l_linenumber, round_even(CAST(l_extendedprice AS DOUBLE) / 7, 2) AS rounded FROM lineitem",
)
def log_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", X.round_half_even(F.col("l_extendedprice").cast("double") / 7).alias("rounded")
    )


@query(
    "text_statistics",
    f"""SELECT doc_id, CASE WHEN s = '' THEN 0 ELSE len(regexp_split_to_array(s, '{SQL_SPACE}+')) END::BIGINT AS words,
     length(text) AS chars, length(replace(text, ' ', '')) AS chars_no_spaces,
     length(text) - length(translate(text, '.!?', '')) AS sentence_marks
     FROM (SELECT doc_id, text, trim(text, '{WS}') AS s FROM documents)""",
)
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[c.alias(n) for n, c in X.text_statistics(F.col("text")).items()]
    )


_UNITS = [("meters", "feet"), ("Feet", "METERS"), ("celsius", "fahrenheit"), ("fahrenheit", "celsius"), ("kg", "pounds"), ("pounds", "kg"), ("kg", "feet")]
_FROM = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_UNITS)) + " END"
_TO = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_UNITS)) + " END"


@query(
    "unit_conversion",
    f"""SELECT event_id, CASE event_id % 7
      WHEN 0 THEN concat(CAST(value AS VARCHAR), ' meters = ', printf('%.2f', value * 3.28084::DOUBLE), ' feet')
      WHEN 1 THEN concat(CAST(value AS VARCHAR), ' feet = ', printf('%.2f', value / 3.28084::DOUBLE), ' meters')
      WHEN 2 THEN concat(CAST(value AS VARCHAR), '°C = ', printf('%.2f', value * 9 / 5 + 32), '°F')
      WHEN 3 THEN concat(CAST(value AS VARCHAR), '°F = ', printf('%.2f', (value - 32) * 5 / 9), '°C')
      WHEN 4 THEN concat(CAST(value AS VARCHAR), ' kg = ', printf('%.2f', value * 2.20462::DOUBLE), ' pounds')
      WHEN 5 THEN concat(CAST(value AS VARCHAR), ' pounds = ', printf('%.2f', value / 2.20462::DOUBLE), ' kg')
      ELSE 'Error: Conversion from kg to feet not supported' END AS told FROM events""",
)
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", X.convert_unit(F.col("value"), F.expr(_FROM), F.expr(_TO)).alias("told")
    )


@query(
    "completion_contract",
    f"""WITH {REWRITE_SQL}, given AS (
     SELECT CASE v WHEN 4 THEN concat('<tool_call>', coalesce(content, '')) WHEN 5 THEN NULL WHEN 6 THEN '' ELSE content END AS content,
      CASE WHEN v IN (1, 2, 3, 4) THEN 1 WHEN v IN (5, 6) THEN 0 ELSE n_calls END AS calls,
      CASE v WHEN 1 THEN 'fn' ELSE 'function' END AS call_type, CASE v WHEN 2 THEN NULL ELSE 'f' END AS call_name, CASE v WHEN 3 THEN NULL ELSE '{{}}' END AS call_arguments,
      CASE WHEN v = 4 THEN 'stop' WHEN v IN (1, 2, 3) THEN 'tool_calls' ELSE finish_reason END AS finish_reason
     FROM (SELECT *, (conv_id * 5 + turn) % 9 AS v FROM rewritten))
    SELECT finish_reason, count(*) AS checked,
     count(*) FILTER (calls = 0 AND coalesce(content, '') = '') AS nothing_said,
     count(*) FILTER (calls > 0 AND call_type <> 'function') AS bad_call_type, count(*) FILTER (calls > 0 AND call_name IS NULL) AS no_call_name,
     count(*) FILTER (calls > 0 AND call_arguments IS NULL) AS no_call_arguments,
     count(*) FILTER (calls > 0 AND contains(coalesce(content, ''), '<tool_call>')) AS raw_call_in_content,
     count(*) FILTER (calls > 0 AND finish_reason <> 'tool_calls') AS wrong_finish_reason
    FROM given GROUP BY finish_reason""",
)
def completion_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Six of nine answers are made to break a rule each.
    given = rewritten(spark, sf_dir)
    v = F.expr("(conv_id * 5 + turn) % 9")
    broken = F.array(
        F.struct(
            F.lit("c").alias("id"), F.when(v == 1, F.lit("fn")).otherwise(F.lit("function")).alias("type"),
            F.struct(F.when(v != 2, F.lit("f")).alias("name"), F.when(v != 3, F.lit("{}")).alias("arguments")).alias("function"),
        )
    ).cast(given.schema["tool_calls"].dataType)
    none = F.array().cast(given.schema["tool_calls"].dataType)
    given = given.withColumns(
        {
            "content": F.when(v == 4, F.concat(F.lit("<tool_call>"), F.coalesce("content", F.lit("")))).when(v == 6, F.lit("")).when(v != 5, F.col("content")),
            "tool_calls": F.when(v.isin(1, 2, 3, 4), broken).when(v.isin(5, 6), none).otherwise(F.col("tool_calls")),
            "finish_reason": F.when(v == 4, F.lit("stop")).when(v.isin(1, 2, 3), F.lit("tool_calls")).otherwise(F.col("finish_reason")),
        }
    )
    return contracts.check_completions(given, ["finish_reason"])


@query(
    "tag_leakage",
    f"""WITH {REWRITE_SQL}
    SELECT conv_id, turn, ({' + '.join(f"CAST(contains(coalesce(content, ''), '{t}') AS INT)" for t in TAGS)})::BIGINT AS leaked_tags
    FROM rewritten WHERE {' OR '.join(f"contains(content, '{t}')" for t in TAGS)}""",
)
def tag_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.leaking_rows(rewritten(spark, sf_dir), "content").select(
        "conv_id", "turn", F.col("leaked_tags").cast("long").alias("leaked_tags")
    )


@query(
    "batch_generation",
    f"""SELECT concat(conv_id, '-', turn) AS request_id, nullif(concat(length(text), ' characters'), '') AS reasoning,
     trim(text, '{WS}') AS content, 'stop' AS finish_reason FROM conversations WHERE role = 'user'""",
)
def batch_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.expr("concat(conv_id, '-', turn)").alias("request_id"), F.col("text").alias("prompt")
    )
    answers = generate_completions(asked, echo_backend(), "request_id string, content string, finish_reason string")
    return C.rewrite_texts(answers, key=("request_id",)).drop("tool_calls", "parse_error")
