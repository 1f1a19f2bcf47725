import json

from pyspark.sql import functions as F

from parley.operators import requests as R
from parley.operators.embeddings import embedding_attributes, embedding_response, indexed_inputs
from parley.sources.requests import read_embedding_requests, read_requests


def test_requests_from_json(spark, tmp_path):
    tool = {"type": "function", "function": {"name": "f", "parameters": {"type": "object"}}}
    lines = [
        {"request_id": "plain", "messages": [{"role": "user", "content": "Salve"}]},
        {"request_id": "null", "messages": [{"role": "assistant", "content": None, "tool_calls": [
            {"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}]},
            {"role": "user", "content": None}], "tools": [tool]},
        {"request_id": "named", "messages": [{"role": "user", "content": [
            {"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "u", "detail": "low"}},
            {"type": "image_url", "image_url": "v"}]}],
            "tools": [tool], "tool_choice": {"type": "function", "function": {"name": "f"}}, "stop": ["a", "b"],
            "logit_bias": {"5": 1.5}},
        {"request_id": "notools", "messages": [], "tools": [], "stop": "end", "function_call": "auto", "temperature": 1},
        {"request_id": "bad", "messages": [{"role": "robot", "content": "x"}, {"role": "tool", "content": "y"}],
         "tool_choice": "maybe", "response_format": {"type": "xml"}},
        {"request_id": "none"},
        {"request_id": "gap", "messages": [{"role": "user"}, {"role": "assistant"}, {"role": "system", "content": [1]}]},
    ]
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines) + '\n{"messages": [\n{"messages": []} x\n{"messages": [], "temperature": "hot"}\n')
    good, bad = read_requests(spark, str(path))
    checked = R.validate_requests(good).cache()
    rows = {r.request_id: r for r in checked.collect()}
    assert bad.count() == 3 and len(rows) == 7
    plain = rows["plain"]
    assert (plain.temperature, plain.max_tokens, plain.stream, plain.top_k) == (0.2, None, False, 40)
    assert plain.tool_choice is None and plain.errors == []
    assert [m.content for m in rows["null"].messages] == ["", None]
    assert rows["null"].tool_choice.mode == "auto" and rows["null"].errors == []
    named = rows["named"]
    assert (named.tool_choice.mode, named.tool_choice.function_name, named.stop) == (None, "f", ["a", "b"])
    assert named.logit_bias == {5: 1.5} and named.errors == []
    assert [(p.type, p.image_url and p.image_url.url) for p in named.messages[0].parts] == [
        ("text", None), ("image_url", "u"), ("image_url", "v")]
    assert rows["notools"].tool_choice is None and rows["notools"].stop == ["end"]
    assert rows["notools"].function_call.mode == "auto" and rows["notools"].temperature == 1.0
    assert set(rows["bad"].errors) == {"role_unknown", "tool_choice_unknown", "response_format_unknown", "tool_call_id_missing"}
    assert rows["none"].errors == ["messages_missing"]
    assert set(rows["gap"].errors) == {"part_malformed", "parts_not_allowed", "content_missing", "content_malformed"}
    valid, quarantine = R.split_valid(checked)
    assert (valid.count(), quarantine.count()) == (4, 3)


def test_a_conversation_is_one_row_whatever_its_turns(spark):
    turns = spark.range(50).select(F.lit(1).alias("conv_id"), (F.col("id") * 300).alias("turn"), F.lit("user").alias("role"),
                                   F.col("id").cast("string").alias("text"))
    row = R.conversation_requests(turns).collect()
    assert len(row) == 1 and [m.content for m in row[0].messages] == [str(i) for i in range(50)]


def test_no_request_ends_the_job(spark, tmp_path):
    lines = ['{"request_id": "a", "messages": [], "logit_bias": {"abc": 1}}', '{"request_id": "b", "messages": [], "logit_bias": {"5": 1, "05": 2}}',
             '{"request_id": "c", "messages": [], "stop": {"x": 1}}', '{"request_id": "d", "messages": [], "stop": [1, true]}',
             '{"request_id": "e", "messages": [], "stop": ["x", null]}', '{"request_id": "f", "messages": [], "logit_bias": {"7": 2}, "stop": []}',
             '{"messages": []} }', '{"messages": []} {"a": 1}', '{"messages": [], "messages": []}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    good, bad = read_requests(spark, str(tmp_path / "r.jsonl"))
    errors = {r.request_id: r.errors for r in R.validate_requests(good).collect()}
    assert bad.count() == 3
    assert errors == {"a": ["logit_bias_malformed"], "b": ["logit_bias_malformed"], "c": ["stop_malformed"], "d": ["stop_malformed"],
                      "e": ["stop_malformed"], "f": []}


def test_embedding_inputs_do_not_vanish(spark, tmp_path):
    lines = ['{"input": "x"}', '{"input": []}', '{"input": 5}', '{"model": "m"}', '{"input": null}', '{"input": ["a", null]}', '{"input": [1, "a"]}', "{", '{"input": "x"} y']
    (tmp_path / "e.jsonl").write_text("\n".join(lines))
    good, bad = read_embedding_requests(spark, str(tmp_path / "e.jsonl"))
    assert sorted(r.input for r in good.collect()) == [[], ["x"]]
    assert sorted(r.errors[0] for r in bad.collect()) == ["input_malformed"] * 3 + ["input_missing"] * 2 + ["unreadable"] * 2


def test_attributes(spark):
    one = spark.createDataFrame(
        [([("user", "Salve"), ("user", "Na hallo")], None, False), ([("user", "x" * 40), ("user", None)], 7, True)],
        "messages array<struct<role:string,content:string>>, max_tokens int, stream boolean")
    rows = R.request_attributes(one).collect()
    assert [(r.input_messages, r.input_content_length, r.max_tokens, r.prompt_tokens) for r in rows] == [
        (2, 13, 0, None), (2, 40, 7, 10)]
    turns = spark.createDataFrame([(1, "Salve"), (1, "Na hallo"), (2, None)], "conv_id int, text string")
    got = {r.conv_id: (r.input_messages, r.input_content_length, r.prompt_tokens)
           for r in R.conversation_attributes(turns).collect()}
    assert got == {1: (2, 13, 3), 2: (1, 0, 1)}


def test_model_ids(spark):
    paths = [("", "/srv/Otter-2b.gguf", "Otter-2b"), (None, "/m/a.b.gguf", "a.b"), ("given", "/tmp/x.gguf", "given"),
             (None, "/m/noext", "noext"), (None, "/m/.hidden", ".hidden"), (None, "/m/dir/", "dir")]
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(paths)], "i int, m string, p string")
    rows = df.orderBy("i").select(R.model_id_of(F.col("m"), F.col("p")).alias("id")).collect()
    assert [r.id for r in rows] == [p[2] for p in paths]


def test_embedding_requests(spark, tmp_path):
    lines = [{"request_id": "one", "input": "text"}, {"request_id": "many", "input": ["Salve", "", "Licht", ""]},
             {"request_id": "none", "input": []}, {"request_id": "over", "input": ["x"] * 2049},
             {"request_id": "full", "input": ["x"] * 2048}]
    path = tmp_path / "e.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in lines))
    good, bad = read_embedding_requests(spark, str(path))
    assert bad.count() == 0
    accepted = good.where(R.within_input_cap(F.col("input")))
    assert {r.request_id for r in accepted.collect()} == {"one", "many", "none", "full"}
    rows = {r.request_id: r for r in embedding_attributes(good).collect()}
    assert (rows["many"].input_count, rows["many"].input_content_length, rows["many"].output_count) == (4, 10, 4)
    assert (rows["none"].input_count, rows["none"].input_content_length, rows["none"].output_count) == (0, 0, None)
    texts = indexed_inputs(good.where("request_id in ('one', 'many', 'none')"))
    assert sorted((r.request_id, r["index"], r.text) for r in texts.collect()) == [
        ("many", 0, "Salve"), ("many", 1, ""), ("many", 2, "Licht"), ("many", 3, ""), ("one", 0, "text")]
    out = embedding_response(texts.withColumn("embedding", F.array(F.lit(1.0))), "served").collect()
    assert {r.model for r in out} == {"served"}
