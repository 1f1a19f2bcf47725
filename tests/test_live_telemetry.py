import uuid

from pyspark.sql import functions as F

from parley.operators.sampling import sampled_spans
from parley.streaming.exposition import SLOTS, batch_totals, exposition, merge_batches, version_before
from parley.streaming.sampling import sample_live

SPANS = "span_id string, trace_id string, ts timestamp, force_sample boolean, score double"
OUT, IN = "f" * 32, "0" * 32  # outside and inside of any ratio


def put(spark, base, name, rows):
    df = spark.createDataFrame([(i, t, float(s), f, 1 / 3) for i, t, s, f in rows], "span_id string, trace_id string, s double, force_sample boolean, score double")
    df = df.select("span_id", "trace_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "force_sample", "score")
    df.coalesce(1).write.parquet(f"{base}/in/{name}")


def sample(spark, base, **settings):
    live = spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    writer = sample_live(live, 0.1, **settings).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    assert writer.trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(SPANS).parquet(f"{base}/out")


def test_a_late_failure_rescues_its_trace_over_restarts(spark, tmp_path):
    base = str(tmp_path / uuid.uuid4().hex)
    put(spark, base, "0", [("a", OUT, 1.000001, False), ("b", OUT, 2, None), ("c", IN, 1, False), ("d", None, 1, True), ("e", None, 1, False), ("f", "e" * 32, 1, False)])
    assert {r.span_id for r in sample(spark, base, wait_ms=None).collect()} == {"c", "d"}
    put(spark, base, "1", [("g", OUT, 3, True), ("h", OUT, 4, False)])
    put(spark, base, "2", [("i", OUT, 5, False), ("j", "e" * 32, 5, False)])
    out = sample(spark, base, wait_ms=None)
    assert {r.span_id for r in out.collect()} == {"a", "b", "c", "d", "g", "h", "i"}
    whole = spark.read.option("recursiveFileLookup", "true").schema(SPANS).parquet(f"{base}/in")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sampled_spans(whole, 0.1).select(*out.columns).collect()))


def test_a_trace_is_forgotten_behind_the_watermark(spark, tmp_path):
    base = str(tmp_path / uuid.uuid4().hex)
    put(spark, base, "0", [("a", OUT, 100, False), ("b", "e" * 32, 100, False)])
    put(spark, base, "1", [("c", OUT, 103, True)])
    put(spark, base, "2", [("d", IN, 1_000, False)])
    put(spark, base, "3", [("e", IN, 2_000, False)])
    put(spark, base, "4", [("f", "e" * 32, 2_001, True)])
    out = sample(spark, base, wait_ms=20_000, lateness="1 second")
    # The failure of c came in time for a; that of f came too late for b.
    assert {r.span_id for r in out.collect()} == {"a", "c", "d", "e", "f"}


MEASURED = (
    "name string, model string, streaming boolean, status_code string, duration_ms double, prompt_tokens long, completion_tokens long, "
    "completion_tokens_per_second double, total_tokens_per_second double, chunk_count long, first_token_delay_ms double, chunk_delay_ms double, "
    "embeddings_per_second double"
)


def measured(spark, n, status="OK"):
    rows = [("slm.chat_completion.streaming", "m", True, status, 100.0 * (i + 1), 5, 7, 1.0, 2.0, 3, 4.0, 5.0, None) for i in range(n)]
    return spark.createDataFrame(rows, MEASURED)


def lines(totals):
    return sorted(map(tuple, exposition(totals).collect()))


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    folder = str(tmp_path / "totals")
    merge = merge_batches(folder)
    batches = [measured(spark, 3), measured(spark, 2, "ERROR"), measured(spark, 0), measured(spark, 4), measured(spark, 1), measured(spark, 2, "ERROR")]
    seen = None
    for i, batch in enumerate(batches):
        seen = batch if seen is None else seen.unionByName(batch)
        merge(batch, i)
        if i % 2:
            merge(batch, i)
        assert lines(version_before(spark, folder)) == lines(batch_totals(seen)), i
    assert spark.read.parquet(folder).select("slot").distinct().count() == SLOTS
    text = [line for _, _, line in lines(version_before(spark, folder))]
    assert 'slm_errors_total{model="m",streaming="streaming"} 4' in text
    assert "# TYPE slm_errors_total counter" in text and any(t.startswith("slm_chunks_total_sum{") for t in text)


def test_no_batch_yet(spark, tmp_path):
    folder = str(tmp_path / "totals")
    merge_batches(folder)(measured(spark, 0), 0)
    assert exposition(version_before(spark, folder)).count() == 0
