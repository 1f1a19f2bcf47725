import random

import pytest
from brute import merge, say

from parley.operators.replay import finish_reasons, lost_tails, replay_streams, stream_calls

PARTS = ["<think>", "</think>", "<tool_call>", "</tool_call>", "<", "</", "<t", "think>", " ", "\n", "a", "é", "tool",
         '{"name":"f","arguments":{"a":1}}', '{"name":"g"}', '{"x":1}', "[1]", "{bad", '{"name":"s","arguments":"raw"}',
         '<tool_call>{"name":"w","arguments":{"k":[1,2]}}</tool_call>', '<tool_call>\n{"name":"v"}\n</tool_call>',
         "<tool_call>{oops</tool_call>", '<tool_call>{"arguments":1}</tool_call>']
SCHEMA = "stream_id string, seq long, role string, content string, finish_reason string"


def soup(rng):
    text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
    if rng.random() < 0.2:
        text = "".join(rng.choice("<t/hink>") for _ in range(rng.randint(1, 60)))
    cuts = []
    while text:
        n = rng.choice([1, 1, 2, 3, 5, 9, 40])
        cuts.append(text[:n])
        text = text[n:]
        if rng.random() < 0.1:
            cuts.append("")
    return cuts


def frame(spark, streams):
    rows = [(k, i, None, t, None) for k, texts in streams.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def events_of(rows):
    rows = sorted(rows, key=lambda r: (r.segment, r.part))
    return merge([(r.kind, r.text, r.call_index, r.name, r.arguments) for r in rows])


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_replay_equals_brute_force(spark, block_rows):
    rng = random.Random(7)
    streams = {f"s{i}": soup(rng) for i in range(400)}
    df = frame(spark, streams)
    got = {}
    for r in replay_streams(df, block_rows).collect():
        got.setdefault(r.stream_id, []).append(r)
    lost = {r.stream_id: r.dropped_tail for r in lost_tails(df, block_rows).collect()}
    calls = 0
    for key, texts in streams.items():
        want, tail = say(texts)
        assert events_of(got.get(key, [])) == want, (key, texts)
        assert lost.get(key, 0) == tail, (key, texts)
        calls += sum(e[0] == "tool_call" for e in want)
    assert calls > 20


GOLDEN = [
    (["Sal", "ut ", "toi"], [("content", "Salut toi")]),
    (["<think>", "count the legs", "</think>", "eight legs"],
     [("reasoning", "count the legs"), ("content", "eight legs")]),
    (["<", "think", ">", "deep", "<", "/think", ">", "seen"], [("reasoning", "deep"), ("content", "seen")]),
    (["a <i>b</i>"], [("content", "a <i>b</i>")]),
    (["<think>", "\n\n", "</think>", "\n\nSalut"], [("content", "Salut")]),
    (["<think>", "\n\nso so", "\n</think>", "\n\neight legs"], [("reasoning", "so so\n"), ("content", "eight legs")]),
    (["<think>", "ok", "</think>", "\n\n", "Hej"], [("reasoning", "ok"), ("content", "Hej")]),
    (["<<think>x"], [("content", "<<think>x")]),
    (["a<tool_call>{\"name\""], [("content", "a")]),
    (["x<thi"], [("content", "x<thi")]),
]


def test_golden_streams(spark):
    df = frame(spark, {f"g{i}": texts for i, (texts, _) in enumerate(GOLDEN)})
    got = {}
    for r in replay_streams(df).collect():
        got.setdefault(r.stream_id, []).append(r)
    for i, (_, want) in enumerate(GOLDEN):
        assert [e[:2] for e in events_of(got[f"g{i}"])] == want


def test_calls_indexed_and_finish_rewritten(spark):
    call = '<tool_call>{"name": "%s", "arguments": {"at": "Rome"}}</tool_call>'
    rows = [
        ("a", 0, "assistant", None, None), ("a", 1, None, call % "x", None), ("a", 2, None, call % "y", None),
        ("a", 3, None, None, "stop"),
        ("b", 0, None, "hi", None), ("b", 1, None, None, "length"),
        ("c", 0, None, "hi", "stop"), ("c", 1, None, call % "z", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    calls = sorted((r.stream_id, r.call_index, r.name, r.arguments) for r in stream_calls(df).collect())
    assert calls == [("a", 0, "x", '{"at":"Rome"}'), ("a", 1, "y", '{"at":"Rome"}'), ("c", 0, "z", '{"at":"Rome"}')]
    assert len({r.call_id for r in stream_calls(df).collect()}) == 3
    for size in (1, 2, 4096):
        reasons = {(r.stream_id, r.seq): r.finish_reason for r in finish_reasons(df, size).collect()}
        assert reasons == {("a", 3): "tool_calls", ("b", 1): "length", ("c", 0): "stop"}


def test_one_hot_stream_spreads_over_blocks(spark):
    rng = random.Random(3)
    hot = [t for _ in range(60) for t in soup(rng)]
    streams = {"hot": hot, **{f"s{i}": soup(rng) for i in range(20)}}
    df = frame(spark, streams)
    out = replay_streams(df, 8).where("stream_id = 'hot'").collect()
    assert events_of(out) == say(hot)[0]
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, replay_streams(df, 4096).where("stream_id = 'hot'").collect()), key=str)
