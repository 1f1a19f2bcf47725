import math
import random

from parley.llm.topk import top_k


def brute(rows, queries, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ids = {i for i, _ in good}
    out = []
    for q in sorted(set(queries) & ids):
        v = min(x for i, x in good if i == q)
        scored = sorted(((-sum(a * b for a, b in zip(v, x)), i) for i, x in good if i != q and len(x) == len(v)))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def check(spark, rows, queries, **settings):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score long")
    asked = df.filter(df.vec_id.isin(queries))
    got = sorted(tuple(r) for r in top_k(df, asked, **settings).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute([(r["vec_id"], r["embedding"]) for r in df.collect()], queries)


def test_blocks_ties_nulls_and_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0, 0.2), 3) for _ in range(12)], 0) for i in range(150)]
    rows += [(200 + i, rows[7][1], 0) for i in range(9)]  # ties
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [math.nan] * 12, 0), (303, [math.inf] * 12, 0), (304, [1.0, 2.0], 0), (305, [], 0), (306, [], 0), (None, rows[0][1], 0)]
    rows += [rows[20], (20, [0.5] * 12, 0)]  # a repeated row, and another with its id
    check(spark, rows, [0, 7, 20, 200, 300, 304, 305], row_block=40, query_block=3)


def test_few_rows_and_none(spark):
    check(spark, [(0, [0.1, 0.2], 0), (1, [0.3, -0.1], 0)], [0])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).count() == 0
