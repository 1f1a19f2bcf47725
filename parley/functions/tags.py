"""Reasoning blocks, tool-call blocks and the tag scanner, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.constants import CALL_CLOSE, CALL_OPEN, TAGS, THINK_CLOSE, THINK_OPEN
from parley.functions.text import SPACE_CLASS, bind, none_if_empty, strip

# Patterns of complete blocks (fixed values).
THINK_BLOCK = "(?s)<think>(.*?)</think>"
CALL_BLOCK = f"(?s)<tool_call>{SPACE_CLASS}*(\\{{.*?\\}}){SPACE_CLASS}*</tool_call>"

PARTIAL_TAGS = tuple(sorted({t[:i] for t in TAGS for i in range(1, len(t))}, key=lambda p: (-len(p), p)))

# A character outside this set can neither extend a started tag nor start one,
# so whatever was held back before it is decided once it has been read.
TAG_BODY = "".join(sorted({ch for t in TAGS for ch in t if ch != ">"}))


def _scan_pattern() -> str:
    """The token language of the scanner, in order of preference.

    A whole tag; a started tag broken by its next character (plain text, and
    not looked at again); a run without ``<``; a started tag at the very end.
    """
    broken = []
    for p in PARTIAL_TAGS:
        following = "".join(sorted({t[len(p)] for t in TAGS if t.startswith(p)}))
        broken.append(f"{re.escape(p)}[^{re.escape(following)}]")
    held = "|".join(re.escape(p) for p in PARTIAL_TAGS)
    return "(?s)" + "|".join([*(re.escape(t) for t in TAGS), *broken, "[^<]+", f"(?:{held})\\z"])


SCAN = _scan_pattern()


def scan_tokens(text: Column) -> Column:
    """Tokens of the text; put together they are the text again."""
    return F.regexp_extract_all(text, F.lit(SCAN), F.lit(0))


def is_tag(token: Column) -> Column:
    return token.isin(*TAGS)


def has_block(text: Column, opening: str, closing: str) -> Column:
    """Cheap test that lets plain text skip the block pattern."""
    return text.contains(opening) & text.contains(closing)


def split_reasoning(text: Column) -> Column:
    """Struct ``reasoning, content``: the think blocks apart from the visible text."""
    blocks = F.when(
        has_block(text, THINK_OPEN, THINK_CLOSE),
        F.regexp_extract_all(text, F.lit(THINK_BLOCK), F.lit(1)),
    )

    def split(b: Column) -> Column:
        found = F.coalesce(F.size(b) > 0, F.lit(False))
        return F.struct(
            F.when(found, none_if_empty(F.array_join(F.transform(b, strip), "\n"))).alias("reasoning"),
            F.when(found, strip(F.regexp_replace(text, THINK_BLOCK, ""))).otherwise(text).alias("content"),
        )

    return bind(blocks, split)


def valid_json(text: Column) -> Column:
    """True for exactly one JSON value and nothing behind it.

    The parser stops after the first value, so the text is put into a list and
    into an object: whatever closes the one early leaves the other open.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return (
        F.try_variant_get(listed, "$[0]", "variant").isNotNull()
        & F.try_variant_get(listed, "$[1]", "variant").isNull()
        & F.try_variant_get(named, "$.v", "variant").isNotNull()
    )


def call_record(body: Column) -> Column:
    """Struct ``name, arguments, is_json, ok`` of one tool-call body.

    ``arguments`` is text: missing gives ``{}``, a string stays as it is, any
    other value becomes compact JSON. ``ok`` needs an object with a name.
    """
    is_json = F.coalesce(valid_json(body), F.lit(False))
    keys = F.json_object_keys(body)
    name = F.get_json_object(body, "$.name")
    arguments = F.coalesce(
        F.get_json_object(body, "$.arguments"),
        F.when(F.array_contains(keys, "arguments"), F.lit("null")).otherwise(F.lit("{}")),
    )
    ok = is_json & keys.isNotNull() & name.isNotNull()
    return F.struct(
        F.when(ok, name).alias("name"),
        F.when(ok, arguments).alias("arguments"),
        is_json.alias("is_json"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def parse_calls(text: Column) -> Column:
    """Struct ``calls, remaining, parse_error`` for all call blocks of a text.

    A block that is no usable call marks the row and leaves the text as it was;
    the job goes on.
    """
    bodies = F.when(
        has_block(text, CALL_OPEN, CALL_CLOSE),
        F.regexp_extract_all(text, F.lit(CALL_BLOCK), F.lit(1)),
    )
    empty = F.array().cast("array<struct<name:string,arguments:string>>")

    def build(calls: Column) -> Column:
        found = F.coalesce(F.size(calls) > 0, F.lit(False))
        bad = F.coalesce(F.exists(calls, lambda c: ~c["ok"]), F.lit(False))
        return F.struct(
            F.when(
                found & ~bad,
                F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))),
            ).otherwise(empty).alias("calls"),
            F.when(found & ~bad, none_if_empty(strip(F.regexp_replace(text, CALL_BLOCK, ""))))
            .otherwise(text)
            .alias("remaining"),
            bad.alias("parse_error"),
        )

    return bind(F.transform(bodies, call_record), build)


def leaked_tags(text: Column) -> Column:
    """How many of the four tags still show up in a text."""
    return bind(
        F.coalesce(text, F.lit("")), lambda t: sum((t.contains(tag).cast("int") for tag in TAGS), F.lit(0))
    )
