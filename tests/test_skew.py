"""One key holds most of the rows: results stay whole and plans spread the key."""

from pyspark.sql import functions as F

from parley.operators import replay
from parley.operators.prefix import running_sums
from parley.operators.requests import conversation_requests


def hot_chunks(spark, n=30_000):
    return spark.range(n).select(
        F.lit("hot").alias("stream_id"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("role"),
        F.expr("CASE id % 100 WHEN 10 THEN '<thi' WHEN 11 THEN 'nk>' WHEN 50 THEN '</think>' WHEN 70 THEN '<tool_call>{\"name\"' "
               "WHEN 71 THEN ': \"f\"}</tool_call>' ELSE 'ab ' END").alias("content"),
        F.expr(f"CASE WHEN id = {n - 1} THEN 'stop' END").alias("finish_reason"))


def test_hot_stream_spreads_over_tasks(spark):
    chunks = hot_chunks(spark)
    out = replay.replay_streams(chunks, 512).cache()
    assert out.where("kind = 'tool_call'").count() == 300
    assert out.where("kind = 'tool_call'").agg(F.max("call_index")).first()[0] == 299
    assert replay.told(chunks, 512).select("block").distinct().count() == 59
    totals = replay.stream_totals(out).first()
    # Per hundred chunks: 38 pieces in reasoning, the other 57 in content, less the blank after each tag.
    assert totals.reasoning_chars == 300 * 38 * 3 and totals.content_chars == 300 * 57 * 3
    text = replay.text_blocks(chunks, 512)
    sizes = text.select(F.size("pieces").alias("n")).collect()
    assert max(r.n for r in sizes) <= 512


def test_hot_key_running_sum(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    got = {r.p: r.s for r in running_sums(df, ["k"], "p", {"s": F.col("v")}, 256).collect()}
    total = 0
    for i in range(20_000):
        total += i % 7
        assert got[i] == total


def test_hot_conversation_is_one_request(spark):
    turns = spark.range(10_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    parts = conversation_requests(turns).select(F.size("messages").alias("n")).collect()
    assert [r.n for r in parts] == [10_000]
