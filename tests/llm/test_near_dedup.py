import random
from collections import defaultdict

import numpy as np
from parley.llm import near_dedup as nd
from parley.llm.linking import classes

from .helpers import SCHEMA, corpus, mixed_rows, text


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def brute(rows, weights, least=0.8):
    texts = sorted({r[1] or "" for r in rows})
    ready = {t: nd.weighted_shingles(t, weights) for t in texts}
    pairs = [(a, b) for i, a in enumerate(texts) for b in texts[:i] if nd.similarity(ready[a], ready[b]) >= least]
    root = grouped(pairs, texts)
    ids = defaultdict(list)
    for i, t, *_ in rows:
        ids[root[t or ""]].append(i)
    return {t: min((i for i in ids[root[t]] if i is not None), default=None) for t in texts}


def near_rows(seed):
    """Originals with many copies that are near the original and less near each other."""
    rng = random.Random(seed)
    rows = mixed_rows(seed, 20)
    i = 1000
    for _ in range(6):
        original = text(rng, "en", 120, 1).split(" ")
        for _ in range(rng.choice([1, 2, 25])):
            copy = list(original)
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            rows.append((i, " ".join(copy), "en", "s0"))
            i += 1
    return rows


def test_classes_equal_brute_force(spark):
    for seed in (1, 2):
        rows = near_rows(seed)
        docs = corpus(spark, rows).selectExpr("*", "1 AS near", "2 AS text_id", "3 AS id")
        want = brute(rows, nd.learn_weights(docs.select("text")))
        got = nd.near_duplicates(docs)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_id", "id", "near"]
        got = got.collect()
        assert len(got) == len(rows)
        assert all(r["near"]["class_id"] == want[r["text"] or ""] for r in got)
        kept = defaultdict(set)
        for r in got:
            if r["near"]["keep"]:
                kept[r["near"]["class_id"]].add((r["doc_id"], r["text"]))
        assert all(len(x) == 1 for x in kept.values()) and set(kept) == {r["near"]["class_id"] for r in got}


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(1)
    sampler = nd.Sampler(samples=3000)
    h = np.sort(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
    a = (h[:220], rng.gamma(2, 1, 220))
    b = (h[40:], np.concatenate([a[1][40:] * rng.choice([1, 1, 2], 180), rng.gamma(2, 1, 80)]))
    same = np.mean(sampler.sample(*a) == sampler.sample(*b))
    assert abs(same - nd.similarity(a, b)) < 0.04


def test_classes_of_chains_and_stars(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)] + [(7, 7)]
    pairs = [p for p in pairs if p[0] != p[1]]
    nodes = {x for p in pairs for x in p}
    want = grouped(pairs, nodes)
    least = defaultdict(list)
    for n, r in want.items():
        least[r].append(n)
    got = {r["id"]: r["root"] for r in classes(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: min(least[r]) for n, r in want.items()}


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_stay_whatever_other_columns_are_called(spark):
    rng = random.Random(4)
    a, b = text(rng, "en", 60), text(rng, "de", 60)
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, a, "en", "s"), (3, b, "de", "s"), (None, b, "de", None), (4, None, None, None), (5, "", "en", "s")]
    docs = corpus(spark, rows).selectExpr("*", "1 AS id", "2 AS again", "3 AS of", "4 AS doc", "5 AS _row", "6 AS near", "7 AS text_id")
    left = nd.survivors(nd.near_duplicates(docs))
    assert left.columns == [*[c for c in docs.columns if c != "near"], "near"]
    got = left.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4] and all((r["id"], r["again"], r["of"], r["doc"], r["_row"], r["text_id"]) == (1, 2, 3, 4, 5, 7) for r in got)
    assert nd.survivors(nd.near_duplicates(docs.limit(0))).count() == 0
