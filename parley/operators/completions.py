"""Completions: rewrite raw model output, project, conform, extract usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from parley.functions.ids import stable_id
from parley.functions.tags import parse_calls, split_reasoning
from parley.functions.text import bind
from parley.schemas import CHOICE, COMPLETION, DELTA_CALL, TOOL_CALL


def model_or(model_id: str | None, model: Column) -> Column:
    """The given model id when it is not empty, else what the record says."""
    return F.coalesce(F.nullif(F.lit(model_id).cast("string"), F.lit("")), model)


def rewrite_texts(df: DataFrame, content: str = "content", key: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rewrite a flat table with one completion text per row.

    Adds ``reasoning, tool_calls, parse_error`` and replaces ``content`` and
    ``finish_reason``. A text whose calls cannot be read keeps its raw content.
    """
    split = df.withColumn("_split", split_reasoning(F.col(content)))
    called = split.withColumn("_called", parse_calls(F.col("_split.content")))
    calls = F.transform(
        "_called.calls",
        lambda c, i: F.struct(
            stable_id("call", *[F.col(k) for k in key], i).alias("id"),
            F.lit("function").alias("type"),
            F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"),
        ),
    )
    made = F.size("_called.calls") > 0
    bad = F.coalesce(F.col("_called.parse_error"), F.lit(False))
    untouched = F.coalesce(F.length(content) == 0, F.lit(True))
    finish = F.col("finish_reason") if "finish_reason" in df.columns else F.lit(None).cast("string")
    return called.select(
        *[c for c in df.columns if c not in (content, "finish_reason")],
        F.when(untouched | bad, F.col(content)).otherwise(F.col("_called.remaining")).alias(content),
        F.when(~bad, F.col("_split.reasoning")).alias("reasoning"),
        F.when(made, calls).alias("tool_calls"),
        F.when(made, F.lit("tool_calls")).otherwise(finish).alias("finish_reason"),
        bad.alias("parse_error"),
    )


def _rewrite_choice(choice: Column, *key: Column) -> Column:
    """One nested choice; a choice without content is handed on as it is."""
    content = choice["message"]["content"]

    def put(split: Column) -> Column:
        def finish(called: Column) -> Column:
            made = F.size(called["calls"]) > 0
            calls = F.transform(
                called["calls"],
                lambda c, i: F.struct(
                    stable_id("call", *key, choice["index"], i).alias("id"),
                    F.lit("function").alias("type"),
                    F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"),
                ),
            )
            message = F.struct(
                choice["message"]["role"].alias("role"),
                called["remaining"].alias("content"),
                F.coalesce(split["reasoning"], choice["message"]["reasoning_content"]).alias("reasoning_content"),
                F.when(made, calls).otherwise(choice["message"]["tool_calls"]).cast(f"array<{TOOL_CALL}>").alias("tool_calls"),
            )
            new = F.struct(
                choice["index"].alias("index"),
                message.alias("message"),
                choice["logprobs"].alias("logprobs"),
                F.when(made, F.lit("tool_calls")).otherwise(choice["finish_reason"]).alias("finish_reason"),
            ).cast(CHOICE)
            return F.when(called["parse_error"], choice.cast(CHOICE)).otherwise(new)

        return bind(parse_calls(split["content"]), finish)

    return F.when(F.length(content) > 0, bind(split_reasoning(content), put)).otherwise(choice.cast(CHOICE))


def rewrite_completions(completions: DataFrame, model_id: str | None = None) -> DataFrame:
    """Rewrite nested completion records: new id, model, and every choice."""
    old_id = F.col("id")
    return completions.withColumns(
        {
            "choices": F.transform("choices", lambda c: _rewrite_choice(c, old_id)),
            "id": stable_id("chatcmpl", old_id),
            "model": model_or(model_id, F.col("model")),
        }
    )


def conform(value: Column, given: DataType, wanted: DataType) -> Column:
    """A value brought to the wanted type by field name; fields it lacks become null."""
    if isinstance(wanted, StructType) and isinstance(given, StructType):
        fields = F.struct(
            *[
                (
                    conform(value[f.name], given[f.name].dataType, f.dataType)
                    if f.name in given.names
                    else F.lit(None).cast(f.dataType)
                ).alias(f.name)
                for f in wanted
            ]
        )
        return F.when(value.isNotNull(), fields)
    if isinstance(wanted, ArrayType) and isinstance(given, ArrayType):
        return F.transform(value, lambda v: conform(v, given.elementType, wanted.elementType))
    if isinstance(wanted, StringType) and isinstance(given, (StructType, ArrayType, MapType)):
        return F.to_json(value)
    return value.cast(wanted)


def conform_completions(df: DataFrame) -> DataFrame:
    """Bring records to the completion schema; what is optional and missing becomes null."""
    wanted = StructType.fromDDL(COMPLETION)
    return df.select(
        *[
            (
                conform(F.col(f.name), df.schema[f.name].dataType, f.dataType)
                if f.name in df.columns
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in wanted
        ]
    )


def first_choice(choices: Column, *path: str) -> Column:
    """A field of the first choice; no choice gives null."""
    value = F.get(choices, F.lit(0))
    for name in path:
        value = value[name]
    return value


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """Nested chunk records as flat rows of their first choice."""
    delta = first_choice(F.col("choices"), "delta")
    return chunks.select(
        "stream_id",
        "seq",
        "model",
        delta["role"].alias("role"),
        delta["content"].alias("content"),
        delta["reasoning_content"].alias("reasoning_content"),
        delta["tool_calls"].cast(f"array<{DELTA_CALL}>").alias("tool_calls"),
        first_choice(F.col("choices"), "finish_reason").alias("finish_reason"),
        delta.isNotNull().alias("has_delta"),
    )


def completion_usage(completions: DataFrame, *keep: str) -> DataFrame:
    """Token counts, output length and finish reason of each (rewritten) completion."""
    content = first_choice(F.col("choices"), "message", "content")
    return completions.select(
        "id",
        *keep,
        *[
            F.when(F.col("usage").isNotNull(), F.coalesce(F.col(f"usage.{n}"), F.lit(0).cast("long"))).alias(n)
            for n in ("prompt_tokens", "completion_tokens", "total_tokens")
        ],
        F.when(first_choice(F.col("choices"), "message").isNotNull(), F.length(F.coalesce(content, F.lit(""))))
        .cast("long")
        .alias("output_content_length"),
        F.nullif(first_choice(F.col("choices"), "finish_reason"), F.lit("")).alias("finish_reason"),
    )
