"""Chat and embedding requests: assemble, normalise, fill in defaults, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.constants import (
    CONTENT_PARTS,
    FUNCTION_CALL_MODES,
    IMAGE_DETAILS,
    MAX_EMBEDDING_INPUTS,
    REQUEST_ROLES,
    RESPONSE_FORMATS,
    SAMPLING_DEFAULTS,
    TOOL_CHOICE_MODES,
)


def conversation_requests(turns: DataFrame) -> DataFrame:
    """(conv_id, messages) from a table of turns: one row per conversation, messages in the order of ``turn``.

    This is the form for export, where a request is one record. Work on the
    contents themselves goes over the table of turns (``conversation_attributes``),
    so that a conversation of any length spreads over tasks.
    """
    return (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias(
                "messages"
            ),
        )
    )


def fill_assistant_content(messages: Column) -> Column:
    """Assistant messages without content get an empty text; other roles stay as they are."""
    return F.transform(
        messages,
        lambda m: m.withField(
            "content",
            F.when((m["role"] == "assistant") & m["content"].isNull(), F.lit("")).otherwise(m["content"]),
        ),
    )


def default_tool_choice(tools: Column, choice: Column) -> Column:
    """``auto`` when there is at least one tool and nothing was chosen."""
    offered = F.coalesce(F.size(tools) > 0, F.lit(False))
    return F.when(offered & choice.isNull(), F.lit("auto")).otherwise(choice)


def with_sampling_defaults(requests: DataFrame) -> DataFrame:
    """Fill every sampling parameter that has a default."""
    types = dict(requests.dtypes)
    return requests.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(types[name])) if name in types else F.lit(value)
            for name, value in SAMPLING_DEFAULTS.items()
        }
    )


def text_list(value: Column) -> Column:
    """A variant that is one text or a list of nothing but texts, as a list; null for anything else."""
    kind = F.schema_of_variant(value)
    listed = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(value, "$", "array<string>"))
    whole = F.when(F.exists(listed, lambda t: t.isNull()), F.lit(None)).otherwise(listed)
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).otherwise(whole)


def is_given(value: Column) -> Column:
    """True where a variant is there and is no JSON null."""
    return value.isNotNull() & (F.schema_of_variant(value) != "VOID")


def bias_map(value: Column) -> Column:
    """Token ids and their numbers from a variant; keys that are no plain whole numbers are left out."""
    texts = F.try_variant_get(value, "$", "map<string,double>")
    plain = F.map_filter(texts, lambda k, v: _plain_number(k) & v.isNotNull())
    return F.transform_keys(plain, lambda k, _: k.cast("int"))


def _plain_number(key: Column) -> Column:
    # "05" and "5" would be one key, so only the plain form counts.
    return F.coalesce(key.try_cast("int").cast("string") == key, F.lit(False))


def _bias_broken(value: Column) -> Column:
    texts = F.try_variant_get(value, "$", "map<string,double>")
    odd = F.exists(F.map_entries(texts), lambda e: ~_plain_number(e["key"]) | e["value"].isNull())
    return is_given(value) & (texts.isNull() | F.coalesce(odd, F.lit(False)))


def embedding_errors(value: Column) -> Column:
    """Names of the rules that an embedding ``input`` (a variant) breaks."""
    missing = ~F.coalesce(is_given(value), F.lit(False))
    malformed = ~missing & text_list(value).isNull()
    rules = F.array(F.when(missing, F.lit("input_missing")), F.when(malformed, F.lit("input_malformed")))
    return F.filter(rules, lambda e: e.isNotNull())


def stop_sequences(stop: Column) -> Column:
    return text_list(stop)


def input_texts(value: Column) -> Column:
    return text_list(value)


def within_input_cap(inputs: Column, cap: int = MAX_EMBEDDING_INPUTS) -> Column:
    """A list may hold at most ``cap`` inputs; the request is rejected otherwise, never cut."""
    return F.coalesce(F.size(inputs) <= cap, F.lit(False))


def input_batch(position: Column, cap: int = MAX_EMBEDDING_INPUTS) -> Column:
    """Number of the request a position falls into when a long list is sent as several."""
    return F.floor(position / F.lit(cap)).cast("long")


def model_id_of(model_id: Column, path: Column) -> Column:
    """The given id, else the file name of the path without its last suffix."""
    # Empty and single-dot path parts do not count.
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    stem = F.regexp_replace(name, r"^(.*[^.].*)\.[^.]+$", "$1")
    stem = F.when(F.regexp_like(name, F.lit(r"^\.+[^.]*$")), name).otherwise(stem)
    return F.coalesce(F.nullif(model_id, F.lit("")), stem)


def content_length(messages: Column) -> Column:
    """Characters of all message contents; missing content counts as empty."""
    return F.aggregate(
        messages, F.lit(0).cast("long"), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit("")))
    )


def estimated_prompt_tokens(chars: Column) -> Column:
    """One token for four characters, at least one."""
    return F.greatest(F.lit(1).cast("long"), F.floor(chars / 4).cast("long"))


def request_attributes(requests: DataFrame) -> DataFrame:
    """What a chat span says about its request, one row per request."""
    length = content_length(F.col("messages"))
    return requests.withColumns(
        {
            "input_messages": F.size("messages").cast("long"),
            "input_content_length": length,
            "max_tokens": F.coalesce(F.col("max_tokens"), F.lit(0)).cast("long"),
            "prompt_tokens": F.when(F.col("stream"), estimated_prompt_tokens(length)),
        }
    )


def conversation_attributes(turns: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """The same numbers straight from a table of turns; sums combine before the shuffle."""
    return (
        turns.groupBy(key)
        .agg(
            F.count("*").alias("input_messages"),
            F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("input_content_length"),
        )
        .withColumn("prompt_tokens", estimated_prompt_tokens(F.col("input_content_length")))
    )


def _is_null_value(content: Column) -> Column:
    """True for a JSON null; a field that is not there at all is no value."""
    return content.isNotNull() & (F.schema_of_variant(content) == "VOID")


def _raw_errors() -> Column:
    """Rules that can only be seen before normalising: a content that is not there, or of a wrong type."""

    def shape(m: Column) -> Column:
        kind = F.schema_of_variant(m["content"])
        listed = (m["role"] == "user") & kind.startswith("ARRAY")
        return ~(kind.isin("STRING", "VOID") | listed)

    rules = {
        "content_missing": _any(F.col("messages"), lambda m: (m["role"] != "assistant") & m["content"].isNull()),
        "content_malformed": _any(F.col("messages"), lambda m: m["content"].isNotNull() & shape(m)),
        "stop_malformed": is_given(F.col("stop")) & text_list(F.col("stop")).isNull(),
        "logit_bias_malformed": _bias_broken(F.col("logit_bias")),
    }
    return F.filter(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda e: e.isNotNull()
    )


def normalise_requests(raw: DataFrame) -> DataFrame:
    """Typed requests from ``schemas.RAW_REQUEST`` rows, with every union resolved.

    ``raw_errors`` keeps what validation could no longer see afterwards.
    """
    part = "array<struct<type:string,text:string,image_url:variant>>"

    def message(m: Column) -> Column:
        is_text = F.schema_of_variant(m["content"]) == "STRING"
        text = F.when(is_text, F.try_variant_get(m["content"], "$", "string"))
        parts = F.when(~is_text, F.try_variant_get(m["content"], "$", part))
        image = lambda v: F.struct(  # noqa: E731 - an image is a link or a struct with a link
            F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
            .otherwise(F.try_variant_get(v, "$.url", "string"))
            .alias("url"),
            F.when(F.schema_of_variant(v) != "STRING", F.try_variant_get(v, "$.detail", "string")).alias("detail"),
        )
        return F.struct(
            m["role"].alias("role"),
            F.when((m["role"] == "assistant") & _is_null_value(m["content"]), F.lit("")).otherwise(text).alias("content"),
            F.transform(
                parts,
                lambda p: F.struct(
                    p["type"].alias("type"),
                    p["text"].alias("text"),
                    F.when(p["image_url"].isNotNull(), image(p["image_url"])).alias("image_url"),
                ),
            ).alias("parts"),
            *[m[f].alias(f) for f in ("name", "tool_call_id", "tool_calls", "function_call")],
        )

    def mode_or_name(value: Column, name_path: str) -> tuple[Column, Column]:
        is_text = F.schema_of_variant(value) == "STRING"
        return (
            F.when(is_text, F.try_variant_get(value, "$", "string")),
            F.when(~is_text, F.try_variant_get(value, name_path, "string")),
        )

    mode, named = mode_or_name(F.col("tool_choice"), "$.function.name")
    fn_mode, fn_name = mode_or_name(F.col("function_call"), "$.name")
    mode = F.when(named.isNull(), default_tool_choice(F.col("tools"), mode))
    return with_sampling_defaults(
        raw.withColumns(
            {
                "raw_errors": _raw_errors(),
                "messages": F.transform("messages", message),
                "stop": stop_sequences(F.col("stop")),
                "logit_bias": bias_map(F.col("logit_bias")),
                "tool_choice": F.when(
                    mode.isNotNull() | F.col("tool_choice").isNotNull(),
                    F.struct(mode.alias("mode"), named.alias("function_name")),
                ),
                "function_call": F.when(
                    F.col("function_call").isNotNull(), F.struct(fn_mode.alias("mode"), fn_name.alias("name"))
                ),
            }
        )
    )


def _any(items: Column, broken) -> Column:
    return F.coalesce(F.exists(items, lambda i: F.coalesce(broken(i), F.lit(False))), F.lit(False))


def _call_broken(c: Column) -> Column:
    return (
        c["id"].isNull()
        | ~c["type"].eqNullSafe("function")
        | c["function"]["name"].isNull()
        | c["function"]["arguments"].isNull()
    )


def request_errors(columns: set[str]) -> Column:
    """Names of the rules a typed request breaks; an empty list means valid."""
    messages, rules = F.col("messages"), {}
    rules["messages_missing"] = messages.isNull()
    rules["role_unknown"] = _any(messages, lambda m: m["role"].isNull() | ~m["role"].isin(*REQUEST_ROLES))
    if "tools" in columns:
        rules["tool_malformed"] = _any(
            F.col("tools"),
            lambda t: ~t["type"].eqNullSafe("function") | t["function"]["name"].isNull() | t["function"]["parameters"].isNull(),
        )
    if "tool_choice" in columns:
        mode, named = F.col("tool_choice.mode"), F.col("tool_choice.function_name")
        rules["tool_choice_unknown"] = F.col("tool_choice").isNotNull() & (
            (mode.isNull() & named.isNull()) | F.coalesce(~mode.isin(*TOOL_CHOICE_MODES), F.lit(False))
        )
    if "function_call" in columns:
        mode, named = F.col("function_call.mode"), F.col("function_call.name")
        rules["function_call_unknown"] = F.col("function_call").isNotNull() & (
            (mode.isNull() & named.isNull()) | F.coalesce(~mode.isin(*FUNCTION_CALL_MODES), F.lit(False))
        )
    if "functions" in columns:
        rules["function_malformed"] = _any(F.col("functions"), lambda f: f["name"].isNull() | f["parameters"].isNull())
    if "response_format" in columns:
        kind = F.col("response_format.type")
        rules["response_format_unknown"] = F.col("response_format").isNotNull() & (
            kind.isNull() | ~kind.isin(*RESPONSE_FORMATS)
        )
    return F.filter(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]),
        lambda e: e.isNotNull(),
    )


def message_errors(fields: set[str]) -> Column:
    """Rules on ids, names, parts and calls of messages, as far as the records have these fields."""
    messages = F.col("messages")
    needs = {
        "tool_call_id_missing": "tool_call_id",
        "function_name_missing": "name",
        "call_malformed": "tool_calls",
        "part_malformed": "parts",
        "parts_not_allowed": "parts",
    }
    rules = {
        "tool_call_id_missing": lambda: _any(messages, lambda m: (m["role"] == "tool") & m["tool_call_id"].isNull()),
        "function_name_missing": lambda: _any(messages, lambda m: (m["role"] == "function") & m["name"].isNull()),
        "call_malformed": lambda: _any(messages, lambda m: _any(m["tool_calls"], _call_broken)),
        "part_malformed": lambda: _any(
            messages,
            lambda m: _any(
                m["parts"],
                lambda p: p["type"].isNull()
                | ~p["type"].isin(*CONTENT_PARTS)
                | ((p["type"] == "text") & p["text"].isNull())
                | ((p["type"] == "image_url") & p["image_url"]["url"].isNull())
                | F.coalesce(~p["image_url"]["detail"].isin(*IMAGE_DETAILS), F.lit(False)),
            ),
        ),
        "parts_not_allowed": lambda: _any(messages, lambda m: (m["role"] != "user") & m["parts"].isNotNull()),
    }
    return F.filter(
        F.array(*[F.when(rules[n](), F.lit(n)) for n, field in needs.items() if field in fields]).cast("array<string>"),
        lambda e: e.isNotNull(),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``errors``; rows without errors are valid. Every rule whose fields are there is checked."""
    fields = set(requests.schema["messages"].dataType.elementType.fieldNames())
    found = [request_errors(set(requests.columns)), message_errors(fields)]
    if "raw_errors" in requests.columns:
        found.append(F.col("raw_errors"))
    return requests.withColumn("errors", F.concat(*found)).drop("raw_errors")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rows for the quarantine table."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
