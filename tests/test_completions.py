import json

from pyspark.sql import functions as F

from parley.operators import completions as C
from parley.operators import contracts
from parley.schemas import COMPLETION

THINK_CALL = '<think>Let me check</think>\n<tool_call>\n{"name": "search", "arguments": {"q": 1}}\n</tool_call>'


def completion(spark, *contents, model="test-model"):
    rows = [
        json.dumps({"id": f"r{i}", "object": "chat.completion", "created": 1, "model": model,
                    "choices": [{"index": 0, "message": {"role": "assistant", "content": c}, "finish_reason": "stop"}],
                    "usage": {"prompt_tokens": 100, "completion_tokens": 50, "total_tokens": 150}})
        for i, c in enumerate(contents)
    ]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return df.select(F.from_json("v", COMPLETION).alias("c")).select("c.*")


def test_rewrite(spark):
    given = completion(spark, "<think>counting rings</think>\n\nNine rings.", THINK_CALL,
                       "<think>\n\n</think>\n\nServus", "Plain", "", None, "<tool_call>{oops}</tool_call>")
    rows = C.rewrite_completions(given).collect()
    seen = [(c.message.content, c.message.reasoning_content, c.message.tool_calls and len(c.message.tool_calls), c.finish_reason)
            for c in (r.choices[0] for r in rows)]
    assert seen == [
        ("Nine rings.", "counting rings", None, "stop"),
        (None, "Let me check", 1, "tool_calls"),
        ("Servus", None, None, "stop"),
        ("Plain", None, None, "stop"),
        ("", None, None, "stop"),
        (None, None, None, "stop"),
        ("<tool_call>{oops}</tool_call>", None, None, "stop"),
    ]
    call = rows[1].choices[0].message.tool_calls[0]
    assert (call.type, call.function.name, json.loads(call.function.arguments)) == ("function", "search", {"q": 1})
    assert call.id.startswith("call_") and all(r.id.startswith("chatcmpl_") for r in rows)
    assert len({r.id for r in rows}) == len(rows) and all(r.usage.total_tokens == 150 for r in rows)
    assert {r.model for r in rows} == {"test-model"}
    assert {r.model for r in C.rewrite_completions(given, "served").collect()} == {"served"}


def test_flat_rewrite_and_contract(spark):
    flat = spark.createDataFrame([("a", THINK_CALL, "stop"), ("b", "<think>only</think>", "stop"), ("c", "hi", "length")],
                                 "id string, content string, finish_reason string")
    out = C.rewrite_texts(flat)
    got = {r.id: (r.content, r.reasoning, r.finish_reason) for r in out.collect()}
    assert got == {"a": (None, "Let me check", "tool_calls"), "b": ("", "only", "stop"), "c": ("hi", None, "length")}
    report = contracts.check_completions(out).first()
    assert (report.checked, report.nothing_said, report.wrong_finish_reason) == (3, 1, 0)
    assert contracts.leaking_rows(out, "content").count() == 0


def test_usage(spark):
    rows = C.completion_usage(completion(spark, "Servus zamma", "")).collect()
    assert [(r.prompt_tokens, r.completion_tokens, r.total_tokens, r.output_content_length) for r in rows] == [
        (100, 50, 150, 12), (100, 50, 150, 0)]


def test_conform(spark):
    sparse = spark.createDataFrame([(1,)], "x int").select(
        F.lit("r").alias("id"),
        F.expr("array(named_struct('index', 0, 'message', named_struct('role', 'assistant')))").alias("choices"))
    out = C.conform_completions(sparse)
    assert out.schema.simpleString() == completion(spark, "x").schema.simpleString()
    row = out.first()
    assert row.choices[0].message.tool_calls is None and row.usage is None and row.choices[0].message.role == "assistant"
    more = spark.range(1).select(
        F.lit("r").alias("id"), F.lit("dropped").alias("extra"), F.lit(5).alias("created"),
        F.expr("array(named_struct('finish_reason', 'stop', 'logprobs', named_struct('a', 1), 'message', null, 'index', 0L))").alias("choices"))
    row = C.conform_completions(more).first()
    assert (row.created, row.choices[0].logprobs, row.choices[0].message) == (5, '{"a":1}', None)
