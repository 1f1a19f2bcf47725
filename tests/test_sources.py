import os

from pyspark.sql import functions as F

from parley.operators.completions import flatten_chunks
from parley.operators.replay import stamp_streams
from parley.schemas import CHUNK
from parley.sources import catalogue
from parley.sources import chunks as W


def nested(spark):
    text = "named_struct('role', string(null), 'content', concat('é\"\\n<', id), 'reasoning_content', string(null), 'tool_calls', cast(null as array<struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>>))"
    choices = f"array(named_struct('index', 0, 'delta', {text}, 'logprobs', string(null), 'finish_reason', CASE WHEN id % 10 = 9 THEN 'stop' END))"
    return spark.range(40).select(
        F.expr("concat('s', id div 10)").alias("stream_id"), F.expr("id % 10").alias("seq"),
        F.lit(None).cast("timestamp").alias("ts"), F.expr("concat('s', id div 10)").alias("id"), F.lit("chat.completion.chunk").alias("object"),
        F.lit(1).cast("long").alias("created"), F.lit("m").alias("model"), F.expr(choices).alias("choices"))


def test_events_round_trip(spark, tmp_path):
    chunks = nested(spark)
    events = W.encode_events(chunks, W.chunk_json())
    assert events.where("event = 'data: [DONE]'").count() == 4
    path = str(tmp_path / "sse")
    W.write_events(events, path, 3)
    raw = "".join(open(os.path.join(path, f), newline="").read() for f in sorted(os.listdir(path)) if f.endswith(".txt"))
    assert raw.count("data: ") == 44 and raw.endswith("data: [DONE]\n\n") and raw.startswith("data: {")
    back = W.read_events(spark, path)
    assert back.where("not done").count() == 40 and back.where("done").count() == 4 and back.where("unreadable").count() == 0
    sent = {(r.stream_id, r.seq, r.c) for r in chunks.select("stream_id", "seq", F.col("choices")[0]["delta"]["content"].alias("c")).collect()}
    assert {(r.stream_id, r.seq, r.content) for r in W.flat_chunks(back.where("not done")).collect()} == sent
    broken = spark.createDataFrame([("data: {oops",), (": comment",), ("data: [DONE]",)], "event string")
    rows = W.decode_events(broken).collect()
    assert len(rows) == 1 and rows[0]._corrupt == "{oops"


def test_event_files_tell_stream_and_order(spark, tmp_path):
    files = {
        "0.txt": ['data: {"id":"s","n":0}', 'data: {"id":"t","n":0}', 'data: {"id":"s","n":1}', "data: {bad"],
        "1.txt": ["data: [DONE]", 'data: {"id":"t","n":1}', ": comment", "data: [DONE]"],
        "2.txt": ['data: {"id":"s","n":4}'],
    }
    for name, events in files.items():
        (tmp_path / name).write_text("".join(e + "\n\n" for e in events), newline="")
    want = {
        ("s", 0, 0, False, False), ("s", 1, 1, False, False), ("s", 2, None, False, True), ("s", 3, None, True, False), ("s", 4, 4, False, False),
        ("t", 0, 0, False, False), ("t", 1, 1, False, False), ("t", 2, None, True, False),
    }
    for size in ("128m", "40b"):  # whole files, and several splits of each
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = W.read_events(spark, str(tmp_path))
        assert {(r.stream_id, r.seq, r.n, r.done, r.unreadable) for r in rows.withColumn("n", F.try_variant_get("record", "$.n", "int")).collect()} == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_records_keep_what_is_not_read(spark, tmp_path):
    lines = [
        '{"stream_id":"a","seq":0,"created":5,"choices":[{"index":0,"delta":{"role":"assistant","content":"x","tool_calls":[1]},"logprobs":{"t":[1.5]}},{"index":1}],"usage":null}',
        '{"stream_id":"a","seq":1,"choices":[]}', '{"stream_id":"a","seq":2,"choices":[{"delta":null,"finish_reason":"stop"}]}', "[1]", '{"stream_id":"b","seq":0,"done":true}', '{"stream_id":"b","seq":1,"choices":5}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines))
    flat = W.flat_chunks(W.chunk_records(spark, str(tmp_path)))
    rows = {(r.stream_id, r.seq): r for r in flat.withColumns({"rest": F.to_json("rest"), "delta_rest": F.to_json("delta_rest")}).collect()}
    first = rows["a", 0]
    assert (first.role, first.content, first.has_delta, first.done) == ("assistant", "x", True, False)
    assert first.rest == '{"choice":{"index":0,"logprobs":{"t":[1.5]}},"created":5,"more":[{"index":1}],"usage":null}' and first.delta_rest == '{"tool_calls":[1]}'
    assert [rows["a", i].has_delta for i in (1, 2)] == [False, False] and rows["a", 2].done and rows["b", 0].done
    assert rows[None, None].content is None and rows["b", 1].content is None


def test_recorded_and_live_chunks(spark, tmp_path):
    path = str(tmp_path / "chunks")
    nested(spark).write.parquet(path)
    flat = flatten_chunks(W.read_chunks(spark, path))
    assert flat.where("has_delta and finish_reason = 'stop'").count() == 4
    live = W.stream_chunks(spark, path)
    assert live.isStreaming and live.schema.simpleString() == spark.createDataFrame([], CHUNK).schema.simpleString()
    ids = stamp_streams(W.read_chunks(spark, path), "served").select("stream_id", "id", "model").distinct().collect()
    assert len(ids) == 4 and {r.model for r in ids} == {"served"} and len({r.id for r in ids}) == 4


def test_catalogue(spark, tmp_path):
    model = tmp_path / "models" / "chat.Q4.gguf"
    model.parent.mkdir()
    model.write_bytes(b"x")
    os.utime(model, (1_700_000_000, 1_700_000_000))
    configured = spark.createDataFrame(
        [("", str(model), None), ("", "/tmp/none/Otter-2b.gguf", "custom-org"), ("emb", "/tmp/none/e.onnx", catalogue.EMBEDDING_OWNER)],
        "model_id string, path string, owned_by string")
    rows = catalogue.model_catalogue(configured, catalogue.model_files(spark, str(tmp_path / "models"))).collect()
    assert sorted(tuple(r) for r in rows) == sorted([
        ("chat.Q4", "model", 1_700_000_000, catalogue.DEFAULT_OWNER), ("Otter-2b", "model", 0, "custom-org"),
        ("emb", "model", 0, catalogue.EMBEDDING_OWNER)])
