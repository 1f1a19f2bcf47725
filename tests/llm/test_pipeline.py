import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from parley.llm import language_id, line_dedup, vocabulary
from pyspark.sql import functions as F

from .helpers import mixed_rows, corpus
from .test_line_dedup import rows_with_shared_lines


def test_stages_keep_the_columns_and_decide(spark, tmp_path):
    rows = rows_with_shared_lines(5) + [(i + 5000, *r[1:]) for i, r in enumerate(mixed_rows(6, 10))] + [(9000, "123 456", "en", "s")]
    docs = corpus(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = [now.count()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(out := str(tmp_path / f"out{k}"))
        now = spark.read.parquet(out)
        if k < len(cp.STAGES) - 1:
            assert now.columns == docs.columns
        sizes.append(now.count())
        if k == 0:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in now.select("doc_id").collect()} >= {9000}
        if k == 2:
            ids = [r["text"] for r in now.collect()]
            assert len(ids) == len(set(ids))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[5] > 0
    again = cp.run(spark, str(tmp_path))
    assert sorted(map(str, again.drop("ids").collect())) == sorted(map(str, now.drop("ids").collect()))


def test_names():
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


@pytest.mark.parametrize("step", [lambda d: language_id.identify(d, language_id.fit([], [])), line_dedup.dedup_lines, vocabulary.word_counts])
def test_whole_texts_go_to_python_in_small_batches(spark, step):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    docs = spark.range(3000).select(F.concat(F.lit("text "), "id").alias("text"), F.col("id").alias("doc_id")).coalesce(1)
    step(docs).count()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    seen = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert max(seen) <= 1000 and sum(seen) == 3000


def test_long_texts_are_told_apart_in_small_groups():
    texts = pa.array(["x" * 100_000] * 20 + ["y" * 3_000_000] + ["z"] * 100)
    groups = list(language_id.in_groups(np.arange(len(texts)), texts))
    assert [i for g in groups for i in g] == list(range(121))
    assert all(len(g) == 1 or sum(len(texts[i].as_py()) for i in g) <= 250_000 for g in groups)
