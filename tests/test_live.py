import random
import uuid

from brute import rewrite
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_replay import soup

from parley.operators.replay import output_chunks
from parley.streaming.rewrite import as_chunks, rewrite_live

SCHEMA = "stream_id string, seq long, role string, content string, finish_reason string, has_delta boolean, done boolean"


def run(spark, tmp_path, parts):
    """Feed the parts as one file each, one file per micro-batch."""
    base = tmp_path / uuid.uuid4().hex
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{i:03d}")
    live = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .parquet(f"{base}/in")
    )
    q = (
        rewrite_live(live, gap_ms=None, idle_ms=None, keep_ms=None).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(200)
    return spark.read.parquet(f"{base}/out")


def test_live_equals_brute_force_over_micro_batches(spark, tmp_path):
    rng = random.Random(11)
    streams, rows = {}, []
    for i in range(60):
        chunks = [("assistant", None, None)]
        chunks += [("assistant" if rng.random() < 0.1 else None, t, None) for t in soup(rng)]
        last = rng.choice([None, "", "end", "</think>", " "])
        chunks.append((None, last, "stop"))
        streams[f"s{i}"] = chunks
        rows += [(f"s{i}", n, *c, True, False) for n, c in enumerate(chunks)]
        rows.append((f"s{i}", len(chunks), None, None, None, True, True))
    # Rows of a stream are spread over the batches out of order, some come twice.
    parts = [[], [], []]
    for r in rows:
        parts[rng.randrange(3)].append(r)
        if rng.random() < 0.1:
            parts[2].append(r)
    out = run(spark, tmp_path, parts)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.stream_id, r.out_no)):
        text = r.call_name if r.kind == "tool_call" else r.content if r.content is not None else r.reasoning_content
        got.setdefault(r.stream_id, []).append((r.seq, r.kind, text, r.role, r.finish_reason))
    recorded = spark.createDataFrame([r for r in rows if not r[6]], SCHEMA)
    replayed = {}
    for size in (1, 7, 4096):
        for r in sorted(output_chunks(recorded, size).collect(), key=lambda r: (r.stream_id, r.seq, r.part)):
            replayed.setdefault((size, r.stream_id), []).append((r.seq, r.kind, r.name if r.kind == "tool_call" else r.text, r.role, r.finish_reason))
    for key, chunks in streams.items():
        want = rewrite(chunks)
        assert got.get(key, []) == want, (key, chunks)
        for size in (1, 7, 4096):
            assert replayed.get((size, key), []) == want, (size, key, chunks)
    nested = as_chunks(out, F.lit(0), F.lit("m"))
    assert nested.select("stream_id").distinct().count() == nested.select("id").distinct().count()
    calls = out.where("kind = 'tool_call'").select("stream_id", "call_index").collect()
    per = {}
    for r in calls:
        per.setdefault(r.stream_id, []).append(r.call_index)
    assert per and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert nested.where("choices[0].delta.tool_calls[0].function.name is not null").count() == len(calls)


def test_running_counters(spark, tmp_path):
    rows = [("a", 0, "assistant", "Ho", None, True, False), ("a", 1, None, " there.", None, True, False),
            ("a", 2, None, "", "stop", True, False), ("a", 3, None, None, None, True, True)]
    out = run(spark, tmp_path, [rows[:2], rows[2:]]).orderBy("out_no").collect()
    assert [(r.completion_tokens, r.output_length) for r in out] == [(1, 2), (2, 9), (2, 9)]
    assert out[-1].finish_reason == "stop"


def started(spark, base, trigger, **settings):
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    writer = rewrite_live(live, **settings).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    return writer.trigger(**trigger).start()


def put(spark, base, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{name}")


def out_rows(spark, base):
    return sorted((r.stream_id, r.seq, r.kind, r.content, r.waiting) for r in spark.read.parquet(f"{base}/out").collect())


def seen_so_far(spark, base):
    try:
        return out_rows(spark, base)
    except AnalysisException:  # nothing is written yet
        return []


def chunk(stream, seq, text, done=False):
    return (stream, seq, None, text, None, True, done)


def test_a_restart_in_the_middle_of_a_tag_a_call_and_a_gap(spark, tmp_path):
    base = str(tmp_path / uuid.uuid4().hex)
    off = {"gap_ms": None, "idle_ms": None, "keep_ms": None}
    call = '{"name": "f", "arguments": {"a": 1}}'
    put(spark, base, "0", [chunk("a", 0, "x<th"), chunk("b", 0, "<tool_call>" + call[:9]), chunk("c", 0, "one "), chunk("c", 2, "three")])
    assert started(spark, base, {"availableNow": True}, **off).awaitTermination(100)
    assert out_rows(spark, base) == [("a", 0, "content", "x", None), ("c", 0, "content", "one ", None)]
    put(spark, base, "1", [chunk("a", 1, "ink>deep"), chunk("b", 1, call[9:20]), chunk("c", 2, "again")])
    assert started(spark, base, {"availableNow": True}, **off).awaitTermination(100)
    put(spark, base, "2", [chunk("a", 2, None, True), chunk("b", 2, call[20:] + "</tool_call>"), chunk("b", 3, None, True), chunk("c", 1, "two "), chunk("c", 3, None, True), chunk("c", 0, "late")])
    assert started(spark, base, {"availableNow": True}, **off).awaitTermination(100)
    rows = spark.read.parquet(f"{base}/out")
    assert [(r.kind, r.reasoning_content) for r in rows.where("stream_id = 'a' and seq = 1").collect()] == [("reasoning", "deep")]
    assert [(r.seq, r.kind, r.call_name, r.call_arguments) for r in rows.where("stream_id = 'b'").collect()] == [(2, "tool_call", "f", '{"a":1}')]
    assert [(r.seq, r.content) for r in rows.where("stream_id = 'c'").orderBy("out_no").collect()] == [(0, "one "), (1, "two "), (2, "three")]
    # Ended streams stay known.
    put(spark, base, "3", [chunk("c", 0, "anew")])
    assert started(spark, base, {"availableNow": True}, **off).awaitTermination(100)
    assert rows.where("stream_id = 'c'").count() == spark.read.parquet(f"{base}/out").where("stream_id = 'c'").count() == 3


def test_a_gap_is_given_up_when_too_many_wait(spark, tmp_path):
    base = str(tmp_path / uuid.uuid4().hex)
    put(spark, base, "0", [chunk("a", 0, "0")] + [chunk("a", i, str(i)) for i in range(2, 9)])
    assert started(spark, base, {"availableNow": True}, gap_ms=None, idle_ms=None, keep_ms=None, most_waiting=6).awaitTermination(100)
    want = [("a", 0, "content", "0", None), ("a", 1, "gap", None, 7)] + [("a", i, "content", str(i), None) for i in range(2, 9)]
    assert out_rows(spark, base) == want


def test_timers_report_a_gap_and_end_a_silent_stream(spark, tmp_path):
    import time

    base = str(tmp_path / uuid.uuid4().hex)
    put(spark, base, "0", [chunk("a", 0, "0 "), chunk("a", 2, "2 "), chunk("a", 3, "<thi"), chunk("b", 0, "b")])
    query = started(spark, base, {"processingTime": "500 milliseconds"}, gap_ms=1_000, idle_ms=9_000, keep_ms=60_000)
    try:
        until = time.time() + 90
        while time.time() < until and len(seen_so_far(spark, base)) < 6:
            time.sleep(1)
    finally:
        query.stop()
    assert out_rows(spark, base) == [
        ("a", 0, "content", "0 ", None), ("a", 1, "gap", None, 2), ("a", 1, "gap", None, 2), ("a", 2, "content", "2 ", None),
        ("a", 4, "content", "<thi", None), ("b", 0, "content", "b", None),
    ]


def test_worker_code_needs_no_package(tmp_path):
    """What runs in Python workers can be loaded where this package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from parley.operators.inference import arithmetic_encoder, echo_backend, onnx_encoder
    from parley.streaming.rewrite import StreamRewriter

    (tmp_path / "f.pkl").write_bytes(
        cloudpickle.dumps([StreamRewriter(None, None, None, 9, None), arithmetic_encoder(), echo_backend(), onnx_encoder("m", "t")])
    )
    code = "import pickle, sys; pickle.load(open('f.pkl', 'rb'))[1]()(__import__('numpy').array(['a b'])); assert 'parley' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)
