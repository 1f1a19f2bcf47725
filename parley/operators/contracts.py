"""Checks that answers keep their contract, as violation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import CALL_CLOSE, CALL_OPEN
from parley.functions.tags import leaked_tags


def completion_violations() -> dict[str, Column]:
    """Broken rules of a rewritten completion row (content, tool_calls, finish_reason)."""
    called = F.coalesce(F.size("tool_calls") > 0, F.lit(False))
    content = F.coalesce("content", F.lit(""))
    return {
        "nothing_said": ~called & (F.length(content) == 0),
        "bad_call_type": F.exists("tool_calls", lambda c: ~c["type"].eqNullSafe("function")),
        "no_call_name": F.exists("tool_calls", lambda c: c["function"]["name"].isNull()),
        "no_call_arguments": F.exists("tool_calls", lambda c: c["function"]["arguments"].isNull()),
        "raw_call_in_content": called & F.contains(content, F.lit(CALL_OPEN)),
        "wrong_finish_reason": called & ~F.col("finish_reason").eqNullSafe("tool_calls"),
    }


def check_completions(rewritten: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows checked and rows breaking each rule."""
    rules = completion_violations()
    return rewritten.groupBy(*(by or [])).agg(
        F.count("*").alias("checked"),
        *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()],
    )


def check_streams(outputs: DataFrame) -> DataFrame:
    """Per stream: no raw call tag in what it said, and something was said or called."""
    text = F.coalesce("text", F.lit(""))
    return outputs.groupBy("stream_id").agg(
        F.bool_or(F.contains(text, F.lit(CALL_OPEN)) | F.contains(text, F.lit(CALL_CLOSE))).alias("raw_call_tag"),
        F.bool_or(F.col("kind").isin("content", "tool_call")).alias("has_output"),
    )


def leaking_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text still shows one of the four tags."""
    return df.withColumn("leaked_tags", leaked_tags(F.col(text))).where("leaked_tags > 0")
