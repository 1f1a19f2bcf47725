"""Queries over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.constants import EXCLUDED_URLS, SAMPLING_DEFAULTS
from parley.operators import requests as R
from parley.operators.embeddings import embedding_attributes, indexed_inputs
from parley.operators.span_metrics import not_excluded
from parley.plans.derive import table
from parley.plans.registry import query
from parley.sources.catalogue import model_catalogue, model_files
from parley.schemas import RAW_REQUEST
from parley.sources.requests import embedding_requests, parse_json, readable

# Every fifth conversation has assistant turns without content.
_TURNS = "CASE WHEN conv_id % 5 = 0 AND role = 'assistant' THEN NULL ELSE text END"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.expr(_TURNS))
    return R.conversation_requests(turns)


@query(
    "conversation_requests",
    """SELECT conv_id, count(*) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles,
     md5(string_agg(text, chr(10) ORDER BY turn)) AS text_hash
     FROM conversations GROUP BY conv_id""",
)
def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conversation_requests(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "\n")).alias("text_hash"),
    )


@query(
    "assistant_content_default",
    f"""SELECT conv_id,
     sum(CASE WHEN role = 'assistant' AND t IS NULL THEN 1 ELSE 0 END)::BIGINT AS filled,
     sum(length(coalesce(t, '')))::BIGINT AS chars, 0::BIGINT AS still_null
     FROM (SELECT *, {_TURNS} AS t FROM conversations) GROUP BY conv_id""",
)
def assistant_content_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = _requests(spark, sf_dir).withColumn("messages", R.fill_assistant_content(F.col("messages")))
    return filled.select(
        "conv_id",
        F.size(F.filter("messages", lambda m: m["content"] == "")).cast("long").alias("filled"),
        R.content_length(F.col("messages")).alias("chars"),
        F.size(F.filter("messages", lambda m: m["content"].isNull())).cast("long").alias("still_null"),
    )


_TOOLS = "CASE WHEN conv_id % 3 = 0 THEN {one} WHEN conv_id % 3 = 1 THEN {none} END"


@query(
    "tool_choice_default",
    """SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'none' WHEN conv_id % 3 = 0 THEN 'auto' END AS tool_choice
     FROM conversations""",
)
def tool_choice_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.expr(_TOOLS.format(one="array('get_weather')", none="cast(array() as array<string>)"))
    chosen = F.expr("CASE WHEN turn % 4 = 0 THEN 'none' END")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", R.default_tool_choice(tools, chosen).alias("tool_choice")
    )


def _sql_default(name: str) -> str:
    value = SAMPLING_DEFAULTS[name]
    kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}[type(value)]
    return f"CAST({value} AS {kind})"


@query(
    "sampling_defaults",
    "SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN turn / 8 END, 0.2) AS temperature, "
    "coalesce(CASE WHEN turn % 3 = 0 THEN turn END, 40) AS top_k, "
    + ", ".join(f"{_sql_default(n)} AS {n}" for n in SAMPLING_DEFAULTS if n not in ("temperature", "top_k"))
    + " FROM conversations",
)
def sampling_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.expr("CASE WHEN turn % 2 = 0 THEN turn / 8 END").alias("temperature"),
        F.expr("CASE WHEN turn % 3 = 0 THEN turn END").alias("top_k"),
    )
    return R.with_sampling_defaults(given).withColumn("mirostat_mode", F.col("mirostat_mode").cast("long"))


@query(
    "request_validation",
    """SELECT conv_id, turn, concat_ws(',',
      CASE WHEN turn % 7 = 6 THEN 'messages_missing' END,
      CASE WHEN turn % 7 <> 6 AND conv_id % 6 = 5 THEN 'role_unknown' END,
      CASE WHEN conv_id % 4 = 3 THEN 'tool_malformed' END,
      CASE WHEN turn % 5 = 4 THEN 'tool_choice_unknown' END,
      CASE WHEN conv_id % 9 = 8 THEN 'response_format_unknown' END,
      CASE WHEN turn % 7 <> 6 AND conv_id % 6 <> 5 AND conv_id % 10 = 2 AND turn % 2 = 1 THEN 'tool_call_id_missing' END,
      CASE WHEN turn % 7 <> 6 AND conv_id % 11 = 1 THEN 'call_malformed' END) AS errors,
     NOT (turn % 7 = 6 OR conv_id % 6 = 5 OR conv_id % 4 = 3 OR turn % 5 = 4 OR conv_id % 9 = 8 OR conv_id % 10 = 2 AND turn % 2 = 1 OR conv_id % 11 = 1) AS valid
     FROM conversations""",
)
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.expr(
            "CASE WHEN turn % 7 <> 6 THEN array(named_struct('role', CASE WHEN conv_id % 6 = 5 THEN 'robot' WHEN conv_id % 10 = 2 THEN 'tool' ELSE role END,"
            " 'content', text, 'tool_call_id', CASE WHEN turn % 2 = 0 THEN 'c' END, 'tool_calls', CASE WHEN conv_id % 11 < 2 THEN"
            " array(named_struct('id', 'c', 'type', 'function', 'function', named_struct('name', CASE WHEN conv_id % 11 = 0 THEN 'f' END, 'arguments', '{}'))) END)) END"
        ).alias("messages"),
        F.expr(
            "array(named_struct('type', CASE WHEN conv_id % 4 = 3 THEN 'plugin' ELSE 'function' END, 'function',"
            " named_struct('name', 'f', 'parameters', '{}')))"
        ).alias("tools"),
        F.expr(
            "CASE WHEN turn % 5 = 4 THEN named_struct('mode', 'maybe', 'function_name', string(null))"
            " WHEN turn % 5 = 3 THEN named_struct('mode', string(null), 'function_name', 'f') END"
        ).alias("tool_choice"),
        F.expr(
            "CASE WHEN conv_id % 9 = 8 THEN named_struct('type', 'xml') WHEN conv_id % 9 = 7 THEN named_struct('type', 'text') END"
        ).alias("response_format"),
    )
    checked = R.validate_requests(given)
    return checked.select(
        "conv_id", "turn", F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid")
    )


# Requests as JSON lines with the real texts; some lines are cut off or go on, unions come in every form.
_QUOTED = "substring(to_json(named_struct('t', text)), 6, length(to_json(named_struct('t', text))) - 6)"
_LINE = f"""CASE WHEN turn % 9 = 8 THEN '{{{{"messages": [' WHEN turn % 9 = 7 THEN '{{{{"messages": []}}}} }}}}'
 ELSE concat('{{{{"request_id": "', conv_id, '-', turn, '", "messages": [{{{{"role": "', role, '", "content": ',
  CASE WHEN turn % 4 = 1 THEN 'null' WHEN turn % 4 = 2 THEN concat('[{{{{"type": "text", "text": ', {_QUOTED}, '}}}}]') ELSE {_QUOTED} END, '}}}}], "stop": ',
  CASE WHEN conv_id % 5 = 0 THEN '"END"' WHEN conv_id % 5 = 1 THEN '["A", "B"]' WHEN conv_id % 5 = 2 THEN '5' WHEN conv_id % 5 = 3 THEN '["A", true]' ELSE 'null' END,
  CASE WHEN conv_id % 7 = 0 THEN ', "logit_bias": {{{{"abc": 1}}}}' WHEN conv_id % 7 = 1 THEN ', "logit_bias": {{{{"5": 1, "05": 2}}}}'
   WHEN conv_id % 7 = 2 THEN ', "logit_bias": {{{{"5": 1.5}}}}' ELSE '' END,
  CASE WHEN conv_id % 2 = 0 THEN ', "tools": [{{{{"type": "function", "function": {{{{"name": "f", "parameters": {{{{}}}}}}}}}}}}]' ELSE '' END,
  CASE WHEN turn % 5 = 0 THEN ', "tool_choice": {{{{"type": "function", "function": {{{{"name": "f"}}}}}}}}' WHEN turn % 5 = 1 THEN ', "tool_choice": "required"' ELSE '' END,
  CASE WHEN turn % 2 = 0 THEN ', "temperature": 0.75' ELSE '' END, '}}}}') END""".format()


@query(
    "request_json_ingest",
    """SELECT conv_id, turn, turn % 9 >= 7 AS unreadable,
      CASE WHEN turn % 9 < 7 THEN concat(conv_id, '-', turn) END AS request_id,
      CASE WHEN turn % 9 < 7 THEN CAST(CASE WHEN turn % 2 = 0 THEN 0.75 ELSE 0.2 END AS DOUBLE) END AS temperature,
      CASE WHEN turn % 9 < 7 THEN CASE turn % 4 WHEN 1 THEN CASE WHEN role = 'assistant' THEN '' END WHEN 2 THEN NULL ELSE text END END AS content,
      CASE WHEN turn % 9 < 7 AND turn % 4 = 2 THEN text END AS part_text,
      CASE WHEN turn % 9 < 7 THEN CASE conv_id % 5 WHEN 0 THEN 'END' WHEN 1 THEN 'A,B' END END AS stop,
      CASE WHEN turn % 9 < 7 AND conv_id % 7 IN (1, 2) THEN CASE WHEN conv_id % 7 = 1 THEN 1.0 ELSE 1.5 END END::DOUBLE AS bias_of_5,
      CASE WHEN turn % 9 < 7 THEN concat_ws(',', CASE WHEN turn % 4 = 2 AND role <> 'user' THEN 'content_malformed' END,
       CASE WHEN conv_id % 5 IN (2, 3) THEN 'stop_malformed' END, CASE WHEN conv_id % 7 IN (0, 1) THEN 'logit_bias_malformed' END) END AS errors,
      CASE WHEN turn % 9 < 7 THEN CASE WHEN turn % 5 = 0 THEN NULL WHEN turn % 5 = 1 THEN 'required' WHEN conv_id % 2 = 0 THEN 'auto' END END AS choice_mode,
      CASE WHEN turn % 9 < 7 AND turn % 5 = 0 THEN 'f' END AS choice_function
     FROM conversations""",
)
def request_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_LINE).alias("line"))
    good, bad = readable(parse_json(lines, "line", RAW_REQUEST))
    typed = R.normalise_requests(good)
    first = F.get("messages", F.lit(0))
    read = typed.select(
        "conv_id",
        "turn",
        F.lit(False).alias("unreadable"),
        "request_id",
        "temperature",
        first["content"].alias("content"),
        F.get(first["parts"], F.lit(0))["text"].alias("part_text"),
        F.array_join("stop", ",").alias("stop"),
        F.try_element_at("logit_bias", F.lit(5)).alias("bias_of_5"),
        F.array_join("raw_errors", ",").alias("errors"),
        F.col("tool_choice.mode").alias("choice_mode"),
        F.col("tool_choice.function_name").alias("choice_function"),
    )
    unread = bad.select("conv_id", "turn", F.lit(True).alias("unreadable"))
    return read.unionByName(unread, allowMissingColumns=True)


@query(
    "stop_sequences",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role WHEN turn % 3 = 1 THEN concat(role, '|', turn) END AS stop,
     CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::BIGINT AS n FROM conversations""",
)
def stop_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr(
        "try_parse_json(CASE turn % 3 WHEN 0 THEN concat('\"', role, '\"') WHEN 1 THEN concat('[\"', role, '\",\"', turn, '\"]') END)"
    )
    stops = table(spark, sf_dir, "conversations").select("conv_id", "turn", R.stop_sequences(given).alias("stop"))
    return stops.select(
        "conv_id",
        "turn",
        F.array_join("stop", "|").alias("stop"),
        F.when(F.col("stop").isNotNull(), F.size("stop")).cast("long").alias("n"),
    )


def _embedding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as embedding requests: one text, a list with an empty text, or an empty list."""
    given = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN array(text) WHEN 1 THEN array(text, '', lang) ELSE cast(array() as array<string>) END"
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), given.alias("input"))


@query(
    "embedding_request_ingest",
    """SELECT doc_id, CAST(turned.i AS BIGINT) AS index, turned.t AS text, NULL AS errors FROM (
      SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (
       SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN [text] ELSE [lang, text] END AS l FROM documents WHERE doc_id % 6 < 2)) AS turned
     UNION ALL SELECT doc_id, NULL, NULL, CASE doc_id % 6 WHEN 3 THEN 'input_missing' WHEN 5 THEN 'unreadable' ELSE 'input_malformed' END
     FROM documents WHERE doc_id % 6 >= 2""",
)
def embedding_request_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr(
        "CASE doc_id % 6 WHEN 0 THEN to_json(named_struct('input', text)) WHEN 1 THEN to_json(named_struct('input', array(lang, text)))"
        " WHEN 2 THEN '{\"input\": 5}' WHEN 3 THEN '{\"model\": \"m\"}' WHEN 4 THEN '{\"input\": [1, \"a\", null]}'"
        " ELSE concat(to_json(named_struct('input', text)), ' x') END"
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    good, bad = embedding_requests(lines, "line")
    texts = good.select("doc_id", F.posexplode("input").alias("index", "text")).withColumn("index", F.col("index").cast("long"))
    return texts.unionByName(bad.select("doc_id", F.array_join("errors", ",").alias("errors")), allowMissingColumns=True)


@query(
    "embedding_request_cap",
    """SELECT l_orderkey // 500 AS request_id, count(*) AS n_inputs, sum(length(concat('part ', l_partkey)))::BIGINT AS chars, count(*) <= 2048 AS accepted,
     (count(*) - 1) // 2048 + 1 AS batches FROM lineitem GROUP BY l_orderkey // 500""",
)
def embedding_request_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lines of five hundred order keys make one request: about as many inputs as are allowed, at any size of the table.
    inputs = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 500").alias("request_id")).agg(
        F.collect_list(F.concat(F.lit("part "), F.col("l_partkey"))).alias("input")
    )
    return inputs.select(
        "request_id",
        F.size("input").cast("long").alias("n_inputs"),
        F.aggregate("input", F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("chars"),
        R.within_input_cap(F.col("input")).alias("accepted"),
        (R.input_batch(F.size("input") - 1) + 1).alias("batches"),
    )


@query(
    "model_catalogue",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE CASE c_custkey % 3 WHEN 0 THEN 'customer' WHEN 1 THEN 'nation' ELSE concat('missing-', c_custkey) END END AS id,
     'model' AS object, c_custkey % 3 < 2 AS has_file, c_custkey % 3 = 2 AS created_at_zero,
     CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'second-state' END AS owned_by FROM customer""",
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each customer serves a model; the files of two tables stand for models that are there.
    name = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'customer.parquet' WHEN 1 THEN 'nation.parquet' ELSE concat('missing-', c_custkey, '.gguf') END")
    configured = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("model_id"),
        F.concat(F.lit(f"{sf_dir.rstrip('/')}/"), name).alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("owned_by"),
    )
    rows = model_catalogue(configured, model_files(spark, sf_dir))
    return rows.select("c_custkey", "id", "object", (F.col("created") > 1_000_000_000).alias("has_file"), (F.col("created") == 0).alias("created_at_zero"), "owned_by")


@query(
    "embedding_input_attributes",
    """SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END::BIGINT AS input_count,
     CASE doc_id % 3 WHEN 0 THEN length(text) WHEN 1 THEN length(text) + length(lang) ELSE 0 END::BIGINT AS input_content_length,
     CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END::BIGINT AS output_count FROM documents""",
)
def embedding_input_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_attributes(_embedding_requests(spark, sf_dir)).drop("input")


@query(
    "embedding_inputs_indexed",
    """SELECT doc_id AS request_id, unnest(CASE doc_id % 3 WHEN 0 THEN [0] WHEN 1 THEN [0, 1, 2] ELSE [] END)::BIGINT AS index,
     unnest(CASE doc_id % 3 WHEN 0 THEN [text] WHEN 1 THEN [text, '', lang] ELSE [] END) AS text FROM documents""",
)
def embedding_inputs_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_inputs(_embedding_requests(spark, sf_dir)).withColumn("index", F.col("index").cast("long"))


@query(
    "model_id_resolution",
    r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'given' ELSE
     CASE WHEN regexp_matches(name, '^.*[^.].*\.[^.]+$') THEN regexp_replace(name, '\.[^.]+$', '') ELSE name END END AS model_id
     FROM (SELECT page_id, list_extract(list_filter(string_split(url, '/'), lambda p: p <> '' AND p <> '.'), -1) AS name FROM pages)""",
)
def model_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("CASE page_id % 4 WHEN 0 THEN 'given' WHEN 1 THEN '' END")
    return table(spark, sf_dir, "pages").select("page_id", R.model_id_of(given, F.col("url")).alias("model_id"))


@query(
    "excluded_urls",
    f"SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '{'|'.join((*EXCLUDED_URLS, '/fr/'))}')",
)
def excluded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = (*EXCLUDED_URLS, "/fr/")
    return table(spark, sf_dir, "pages").select("page_id", "url").where(not_excluded(F.col("url"), patterns))


@query(
    "input_content_length",
    f"""SELECT conv_id, sum(length(coalesce({_TURNS}, '')))::BIGINT AS input_content_length
     FROM conversations GROUP BY conv_id""",
)
def input_content_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _requests(spark, sf_dir).select("conv_id", R.content_length(F.col("messages")).alias("chars"))
    return parts.groupBy("conv_id").agg(F.sum("chars").alias("input_content_length"))


@query(
    "request_attributes",
    """SELECT conv_id, count(*) AS input_messages, sum(length(text))::BIGINT AS input_content_length,
     CASE WHEN conv_id % 2 = 0 THEN 0 ELSE 64 END::BIGINT AS max_tokens, CASE WHEN conv_id % 5 = 0 THEN 0.5 END::DOUBLE AS temperature,
     CASE WHEN conv_id % 3 = 0 THEN greatest(1, CAST(floor(sum(length(text)) / 4.0) AS BIGINT)) END AS prompt_tokens
     FROM conversations GROUP BY conv_id""",
)
def request_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = R.conversation_requests(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "messages",
        F.expr("CASE WHEN conv_id % 2 <> 0 THEN 64 END").alias("max_tokens"),
        F.expr("CASE WHEN conv_id % 5 = 0 THEN 0.5 END").cast("double").alias("temperature"),
        F.expr("conv_id % 3 = 0").alias("stream"),
    )
    return R.request_attributes(requests).drop("stream", "messages")


@query(
    "prompt_token_estimate",
    """SELECT conv_id, count(*) AS input_messages, sum(length(text))::BIGINT AS input_content_length,
     greatest(1, CAST(floor(sum(length(text)) / 4.0) AS BIGINT)) AS prompt_tokens
     FROM conversations GROUP BY conv_id""",
)
def prompt_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conversation_attributes(table(spark, sf_dir, "conversations"))
