import math
import random
import zlib
from collections import Counter

import numpy as np
from parley.llm import lm_scoring as lm
from pyspark.sql import functions as F

from .helpers import corpus, mixed_rows, text


def scored(spark, rows):
    docs = corpus(spark, rows).select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("word"))
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1)
    out = lm.score(docs.withColumn("trains", ~F.col("held_out")), "text", "trains")
    assert out.columns == ["doc_id", "n", "word", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return out.collect()


def tokens_of(t):
    return (t or "").encode().lower().split()


def test_counts_and_base_by_hand_and_score_above_base(spark):
    rng = random.Random(3)
    rows = mixed_rows(3, 200) + [(1000 + i, text(rng, g, 120), g, "s") for i in range(300) for g in [rng.choice(["en", "de", "fr"])]]
    training = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    counts = Counter(w for r in training for w in tokens_of(r[1]))
    counts[None] = len(training)
    total, distinct = sum(counts.values()), len(counts)
    base = lambda w: math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1)))
    want = Counter()
    for r in rows:
        tokens = [*tokens_of(r[1]), None]
        want[r[0], len(tokens), sum(counts[w] > 0 for w in tokens), round(sum(map(base, tokens)), 4)] += 1
    got = scored(spark, rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    held = [r for r in got if r["held_out"]]
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_of_all_words_add_up():
    rng = np.random.default_rng(1)
    head = [(b"w%d" % i, 500 - i) for i in range(300)]
    endings = {}
    for w, n in head:
        g = lm.ending_of(w)
        a, b = endings.get(g, (0, 0))
        endings[g] = a + n, b + 1
    lexicon = lm.Lexicon(head, endings, sum(n for _, n in head) + 40, 301, 40)
    p = lm.Parameters(lexicon.frequency)
    flat = p.flat() + rng.normal(0, 0.3, len(p.flat())).astype(np.float32)
    scorer = lm.Scorer(flat, lm.log_sums(lm.Parameters.of(flat)))
    for a, b in ((0, 0), (3, 0), (1700, 40)):
        every = [10 ** scorer.log10(np.array([a]), np.array([b]), np.array([w])) for w in range(lm.CLASSES)]
        assert abs(sum(every) - 1) < 1e-3


def test_no_training_text(spark):
    docs = corpus(spark, [(1, "some words", None, None), (2, None, None, None)]).withColumn("trains", F.lit(False))
    got = {r["doc_id"]: r for r in lm.score(docs, "text", "trains").collect()}
    assert got[2]["n_tokens"] == 1 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert lm.score(docs.limit(0), "text", "trains").count() == 0


def test_columns_of_any_names(spark):
    docs = corpus(spark, [(1, "some words", "x", "y"), (2, None, None, None)]).withColumns({"trains": F.lit(True), "score": F.lit("mine"), "rare": F.lit(1), "_row": F.lit(2), "row": F.lit(3), "_text": F.lit(4)})
    out = lm.score(docs, "text", "trains")
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "rare", "_row", "row", "_text", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert sorted((r["doc_id"], r["rare"], r["row"], r["_text"], r["n_tokens"]) for r in out.collect()) == [(1, 1, 3, 4, 3), (2, 1, 3, 4, 1)]


def test_workers_need_no_package(tmp_path):
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(lm.__file__).resolve().parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from parley.llm import lm_scoring as lm
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "some words"), (2, "more words")], "doc_id long, text string").withColumn("trains", F.lit(True))
assert lm.score(docs, "text", "trains").count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=180, capture_output=True)
