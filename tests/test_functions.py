import json
import random

from pyspark.sql import functions as F

from parley.functions import tags as T
from parley.functions import text as X
from parley.functions.ids import random_id, stable_id


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")


REASONING = [
    ("<think>\none\ntwo..\n</think>\n\nSalut", "one\ntwo..", "Salut"),
    ("<think>\n\n</think>\n\nSalut", None, "Salut"),
    ("nothing special", None, "nothing special"),
    ("<think>alpha</think>\nbetween\n<think>omega</think>\nafter",
     "alpha\nomega", "between\n\nafter"),
    ("<think>only this</think>", "only this", ""),
    (" padded ", None, " padded "),
    ("<think>open", None, "<think>open"),
    ("x </think>", None, "x </think>"),
    ("<<think>a</think>", "a", "<"),
    (None, None, None),
]


def test_reasoning(spark):
    rows = column(spark, [r[0] for r in REASONING]).select("i", T.split_reasoning(F.col("v")).alias("s")).collect()
    assert [(r.s.reasoning, r.s.content) for r in rows] == [r[1:] for r in REASONING]


def call(name, args):
    return f'<tool_call>\n{{"name": "{name}", "arguments": {args}}}\n</tool_call>'


CALLS = [
    (call("tide", '{"place": "Oslo"}'), [("tide", {"place": "Oslo"})], None, False),
    (call("tide", "{}") + call("moon", "{}"), [("tide", {}), ("moon", {})], None, False),
    ("plain", [], "plain", False),
    ("", [], "", False),
    ("before it\n" + call("f", "{}") + "\nbehind it", [("f", {})],
     "before it\n\nbehind it", False),
    (call("f", '"{\\"key\\": \\"val\\"}"'), [("f", {"key": "val"})], None, False),
    (call("f", "null"), [("f", None)], None, False),
    ('<tool_call>{"name": "f"}</tool_call>', [("f", {})], None, False),
    ('<tool_call>{"name" 1}</tool_call> a', [], '<tool_call>{"name" 1}</tool_call> a', True),
    ('<tool_call>{"arguments": 1}</tool_call>', [], '<tool_call>{"arguments": 1}</tool_call>', True),
    ('<tool_call>{"name": "f"} junk</tool_call>', [], '<tool_call>{"name": "f"} junk</tool_call>', False),
    ('<tool_call>{"name": "a"} x </tool_call><tool_call>{"name": "b"}</tool_call>', [],
     '<tool_call>{"name": "a"} x </tool_call><tool_call>{"name": "b"}</tool_call>', True),
    ('<tool_call> {"name": "wide"} </tool_call>', [("wide", {})], None, False),
]


def test_calls(spark):
    rows = column(spark, [c[0] for c in CALLS]).select("i", T.parse_calls(F.col("v")).alias("p")).collect()
    for r, (text, calls, remaining, bad) in zip(rows, CALLS):
        assert [(c.name, json.loads(c.arguments)) for c in r.p.calls] == calls, text
        assert r.p.remaining == remaining, text
        assert r.p.parse_error is bad, text


def test_tokens_put_together_are_the_text(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["<", "</", "<think>", "</think>", "<tool_call>", "t", "think>", "é", " "]) for _ in range(30))
             for _ in range(300)]
    rows = column(spark, texts).select("v", F.array_join(T.scan_tokens(F.col("v")), "").alias("w")).collect()
    assert all(r.v == r.w for r in rows)


def test_strip_like_unicode(spark):
    texts = ["　\x1c a b\n\x85", "​keep​", "", "\x0b\x0c", "x", "﻿y "]
    rows = column(spark, texts).select("v", X.strip(F.col("v")).alias("s"), X.lstrip(F.col("v")).alias("l")).collect()
    assert [(r.s, r.l) for r in rows] == [(t.strip(), t.lstrip()) for t in texts]


def test_text_statistics(spark):
    texts = ["One two.  Three! four?", "", "  　 ", "a\x1cb c d", "x" * 50 + "\n" + "y..."]
    rows = column(spark, texts).select("v", *[c.alias(n) for n, c in X.text_statistics(F.col("v")).items()]).collect()
    for r, t in zip(rows, texts):
        assert (r.words, r.chars, r.chars_no_spaces) == (len(t.split()), len(t), len(t.replace(" ", ""))), t
        assert r.sentence_marks == t.count(".") + t.count("!") + t.count("?")


def test_ids_tell_keys_apart(spark):
    rows = [("a", "b"), ("a|b", None), (None, "a|b"), (None, None), ("", None), ("", ""), ("a:", "b"), ("1:a", "b"), ("a", None)]
    got = spark.createDataFrame(rows, "x string, y string").select(stable_id("k", F.col("x"), F.col("y")).alias("i")).collect()
    assert len({r.i for r in got}) == len(rows)


def test_json_with_something_behind_it_is_no_json(spark):
    bodies = ['{"name":"f"}] x', '{"name":"f"}} x', '{"name":"f"} {}', '{"name":"f"},{}', '{"name":"f","name":"g"}', '{"name":NaN}', '{"name":"f"}, "w": 1', "", "1 2"]
    good = ['{"name":"f"}', ' {"a": [1]} ', "[1]", "null", "1", '"x"']
    rows = column(spark, bodies + good).select("v", T.valid_json(F.col("v")).alias("ok")).collect()
    assert [bool(r.ok) for r in rows] == [False] * len(bodies) + [True] * len(good)


def test_ids(spark):
    rows = spark.range(2000).select(stable_id("chatcmpl", F.col("id")).alias("a"), random_id("call").alias("b"))
    got = rows.collect()
    assert len({r.a for r in got}) == 2000 == len({r.b for r in got})
    assert all(r.a.startswith("chatcmpl_") and len(r.a) < 30 and r.a[9:].isalnum() for r in got)
    assert all(r.b.startswith("call_") and len(r.b) < 30 for r in got)
    assert rows.select("a").collect() == rows.select("a").collect()


def test_rounding_and_units(spark):
    r = spark.range(1).select(X.round_half_even(F.lit(0.125)).alias("x"), X.round_half_even(F.lit(333.3333)).alias("y"),
                              X.convert_unit(F.lit(100.0), F.lit("Celsius"), F.lit("fahrenheit")).alias("c"),
                              X.convert_unit(F.lit(1.5), F.lit("kg"), F.lit("mile")).alias("n")).first()
    assert (r.x, r.y, r.c) == (0.12, 333.33, "100.0°C = 212.00°F")
    assert r.n == "Error: Conversion from kg to mile not supported"


def test_units_round_exact_values(spark):
    given = [0.125, 0.375, 1.005, 2.675, -0.125, -0.001, 1e7, 123456789.125, 0.0001, 1e-5, 1e16, 1.5e-7, 560.21]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v double")
    two, text = X.two_decimals(F.col("v")), X.number_text(F.col("v"))
    told = rows.select("v", two.alias("two"), text.alias("text"), X.convert_unit(F.col("v"), F.lit("kg"), F.lit("pounds")).alias("told")).orderBy("i").collect()
    assert [r.two for r in told] == [f"{v:.2f}" for v in given]
    assert [r.text for r in told] == [str(v) for v in given]
    assert [r.told for r in told] == [f"{v} kg = {v * 2.20462:.2f} pounds" for v in given]


def test_leaked_tags(spark):
    rows = column(spark, ["a", "<think>", "</tool_call><tool_call>", None]).select(T.leaked_tags(F.col("v")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 2, 0]
