import math
import random

import numpy as np
import pytest

from parley.llm.hard_negatives import Heaps, mine, products, strassen


def brute(rows, anchors):
    good = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows if None not in (i, v, g) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in sorted({i for i, _, _ in good} & set(anchors)):
        _, label, v = min(((i, g, x) for i, g, x in good if i == a), key=lambda r: (r[1], r[2]))
        scored = [(-sum(x * y for x, y in zip(v, w)), i, g) for i, g, w in good if i != a and len(w) == len(v)]
        for minus, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            hard = sorted(s for s in scored if s[2] != label and 30 * -minus <= 100 * -s[0] <= 90 * -minus)[:10]
            out += [(a, p, r + 1, n, -minus, -s) for r, (s, n, _) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, anchors, **settings):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label long, anchor_id long, rank int")
    got = mine(df, df.filter(df.vec_id.isin(anchors)), **settings)
    kept = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(kept, anchors)


@pytest.mark.parametrize("shape", [(1, 1, 1), (9, 64, 13), (0, 4, 3), (5, 0, 7), (33, 65, 130), (16, 16, 16)])
def test_strassen_is_the_product(shape):
    rng, (m, k, n) = np.random.default_rng(1), shape
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    for leaf in (1, 2, 8):
        assert (strassen(a, b, leaf) == a @ b).all()


def test_products_near_and_beyond_a_long():
    a = np.array([[2.0**31, 1.0], [-(2.0**40), 3.0]])
    b = np.array([[2.0**31, -1.0], [2.0**40, 5.0]])
    assert products(a, b, leaf=1).tolist() == [[2**62 - 1, 2**63 - 1], [-(2**63), -(2**63)]]


def test_heaps_merge_as_one():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-3, 3, (4, 60)), rng.permutation(60)
    allowed = rng.random((4, 60)) < 0.8
    parts = Heaps(4, 6)
    for j in range(0, 60, 7):
        parts.offer(scores[:, j : j + 7], ids[j : j + 7], allowed[:, j : j + 7])
    for i in range(4):
        want = sorted((-scores[i, j], ids[j]) for j in range(60) if allowed[i, j])[:6]
        mine_ = parts.owner == i
        assert [(-s, d) for s, d in zip(parts.score[mine_], parts.id[mine_])] == want


def test_blocks_ties_nulls_and_odd_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [round(rng.gauss(0.1, 0.2), 3) for _ in range(12)], rng.randint(0, 3)) for i in range(160)]
    rows += [(200 + i, rows[7][1], i % 2) for i in range(40)]  # many ties under two labels
    rows += [(300, None, 0), (301, [1.0, None], 0), (302, [math.nan] * 12, 0), (303, [math.inf] * 12, 0), (304, [1.0, 2.0], 0), (305, [], 0), (306, [], 0)]
    rows += [(307, [], 1), (None, rows[0][1], 0), (308, rows[0][1], None), (309, [0.5, 2.0], 1), (310, [1.5, 2.0], 0)]
    rows += [rows[20], rows[20], (20, [0.5] * 12, 3)]  # repeated rows, and another with their id
    check(spark, rows, [0, 7, 20, 200, 201, 300, 304, 305, 308], row_block=50, anchor_block=3)
    check(spark, rows, [0, 7, 20, 200])


def test_negative_scores_have_no_window(spark):
    check(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.5], 1), (3, [0.0], 0), (4, [0.0], 1)], [0])


def test_few_rows_and_none(spark):
    check(spark, [(0, [0.1, 0.2], 0)], [0])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine(df, df).count() == 0
