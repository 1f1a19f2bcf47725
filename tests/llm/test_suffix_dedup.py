import random

from parley.llm import suffix_dedup as s

from .helpers import corpus, mixed_rows, text


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            w = d[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d in data:
        spans = [(i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1]
        out.append(s.merged(spans))
    return out


def check(spark, rows, length, **settings):
    docs = corpus(spark, rows).selectExpr("*", "1 AS key", "2 AS repeats")
    got = s.remove_repeats(docs, length=length, **settings).collect()
    want = {}
    for (i, t, *_), spans in zip(rows, brute([r[1] for r in rows], length)):
        d = (t or "").encode()
        edges = [0, *(x for p in spans for x in p), len(d)]
        want.setdefault((i, t), (spans, b"".join(d[a:b] for a, b in zip(edges[::2], edges[1::2]))))
    assert len(got) == len(rows)
    for r in got:
        spans, kept = want[r["doc_id"], r["text"]]
        assert [(x["start"], x["stop"]) for x in r["repeats"]["spans"]] == spans, r["doc_id"]
        assert bytes(r["repeats"]["kept"]) == kept and r["repeats"]["n_bytes"] == len((r["text"] or "").encode())


def planted(seed, n=40):
    rng = random.Random(seed)
    passages = [text(rng, "fr", 20, 1) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [text(rng, "en", rng.randint(3, 25), 1)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(20, len(p))], text(rng, "de", rng.randint(0, 6) + 1, 1)]
        rows.append((i, "".join(parts), "en", "s"))
    return rows


def test_planted_passages(spark):
    for seed in (1, 2, 3):
        check(spark, planted(seed), 60)


def test_wide_groups_are_counted_instead(spark):
    check(spark, planted(4), 60, wide=3)


def test_production_length_nulls_copies_and_long_texts(spark):
    rows = mixed_rows(12, 30)
    long = rows[33][1] if rows[33][1] and len(rows[33][1]) > 5000 else next(r[1] for r in rows if r[1] and len(r[1]) > 5000)
    rows += [(500, "x" + long[1000:3000] + "y" + long[1200:1700], "en", "s"), (501, "ab" * 600, "en", "s"), (502, "é" * 250, "fr", "s")]
    check(spark, rows, 400)


def test_empty_table(spark):
    assert s.remove_repeats(corpus(spark, [])).count() == 0


def test_deep_shallow_order():
    rng = random.Random(3)
    for n in (1, 2, 5, 60):
        for alphabet in ("ab", "abcdefgh"):
            strings = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 40, 120]))).encode() for _ in range(n)]
            strings += [strings[0], strings[0] + b"a", b"a" * 200, b"a" * 199 + b"b", b"a" * 200]
            order, prefixes = s.deep_shallow(strings, shallow=16)
            assert [strings[i] for i in order] == sorted(strings)
            assert prefixes[0] == 0
            assert prefixes[1:] == [s.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_periodic_texts_and_near_copies_have_few_contexts(spark):
    rng = random.Random(6)
    base = text(rng, "en", 60, 1)
    rows = [(i, base[:200] + f"edit{i}" + base[200:], "en", "s") for i in range(12)]
    rows += [(50, "foo bar " * 3000, "en", "s"), (51, "x" + "foo bar " * 40 + "y", "en", "s"), (52, "a" * 5000, None, None), (53, None, None, None), (54, "", "en", "s")]
    for wide in (3, 100_000):
        check(spark, rows, 60, wide=wide)
    check(spark, rows, 400)
