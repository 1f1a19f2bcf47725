import hashlib

from parley.llm import fingerprints
from parley.llm.queries import op8_imatch_fingerprints
from pyspark.sql import functions as F

from .helpers import corpus, mixed_rows


def written(tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def likeness(a, b):
    told = [(x, y) for x, y in zip(a.split(","), b.split(",")) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in told) / len(told) if told else float(a == b)


def test_edits_next_texts_and_likeness(spark, tmp_path):
    rows = [r for r in mixed_rows(6, 150) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r["doc_id"]: r for r in op8_imatch_fingerprints(spark, written(tmp_path, corpus(spark, rows))).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    for this, following in zip(order, order[1:] + order[:1]):
        a, b, r = this[1] or "", following[1] or "", got[this[0]]
        half = len(a) // 2
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest()
        assert abs(r["near_next"] - likeness(r["fingerprint"], got[following[0]]["fingerprint"])) < 1e-12
        assert abs(r["near_edited"] - likeness(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
    by_text = {}
    for r in rows:
        by_text.setdefault(r[1] or "", set()).add(got[r[0]]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    sure = [got[r[0]] for r in rows if len((r[1] or "").split()) >= 40]
    assert sum(r["near_edited"] > r["near_next"] for r in sure) > 0.8 * len(sure)


def test_slices_do_not_change_who_is_next(spark):
    docs = corpus(spark, mixed_rows(7, 40)).select("doc_id", "text")
    seen = []
    for per_slice in (3, 11, 10_000):
        rows = fingerprints.with_next(docs, per_slice).filter(~F.col("guest")).select("doc_id", "text", "next_text").collect()
        seen.append(sorted(map(str, rows)))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == docs.count()


def test_prints_of_the_lexicon_by_hand(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 5} only{i}") for i in range(30)], "doc_id long, text string")
    table = fingerprints.lexicon(docs, least=0.1, most=0.5)
    assert sum(table) <= 5  # word0 to word4
    out = fingerprints.with_fingerprints(docs.withColumn("p", F.lit(1)), {"p": F.col("text")}, table)
    prints = {r["doc_id"]: r["p"] for r in out.collect()}
    assert all((prints[i] == prints[j]) == (i % 5 == j % 5) for i in prints for j in prints)


def test_empty_table(spark, tmp_path):
    assert op8_imatch_fingerprints(spark, written(tmp_path, corpus(spark, []))).count() == 0
