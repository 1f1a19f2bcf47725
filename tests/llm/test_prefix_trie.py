import hashlib
import random

import pytest

from parley.llm.prefix_trie import blocks, hashed, nodes

SCHEMA = "conv_id long, turn long, role string, text string, place long, content int, words int"


def brute(rows):
    talks: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    found: dict = {}
    for conv, said in talks.items():
        path = tuple(x[2:] for x in sorted(said))
        for d in range(len(path) + 1):
            found.setdefault(path[:d], {"all": [], "ends": []})["all"].append(conv)
        found[path]["ends"].append(conv)
    out = []
    for path, n in found.items():
        under = [p for p in found if p[: len(path)] == path]
        is_child = lambda p, q: len(p) == len(q) + 1 and p[: len(q)] == q
        leaves = sum(not any(is_child(p, q) for p in under) for q in under)
        saved = sum((len(found[p]["all"]) - 1) * len(p[-1][1].split()) for p in under if p)
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        parent = min(found[path[:-1]]["all"]) if path else None
        out.append((min(n["all"]), len(path), parent, len(n["all"]), sum(is_child(p, path) for p in under), leaves, saved, ends))
    return sorted(out, key=str)


def check(spark, rows, size=4):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    turns = hashed(df)
    got = nodes(turns, turns.select("conv_id").distinct(), size)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def talk(rng, conv, turns):
    return [(conv, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "c", "d e f"])) for t in range(turns)]


@pytest.mark.parametrize("size", [1, 2, 4])
def test_random_beginnings_and_ends(spark, size):
    rng = random.Random(size)
    rows = [r for conv in range(120) for r in talk(rng, conv, rng.choice([1, 1, 2, 3, 4, 5, 8]))]
    base = talk(rng, 0, 11)
    for conv in range(200, 260):  # long shared beginnings, cut anywhere, some going on
        kept = rng.randint(1, 11)
        rows += [(conv, t, role, text) for _, t, role, text in base[:kept]] + [(conv, t + 20, role, text) for _, t, role, text in talk(rng, conv, rng.choice([0, 0, 2]))]
    rows += [(conv, *r[1:]) for conv in range(300, 340) for r in base]  # copies
    rows += [(None, 0, "user", "x"), (-5, None, "user", "first"), (-5, 0, "user", "next"), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    check(spark, rows, size)


def test_one_long_conversation(spark):
    rng = random.Random(2)
    long = talk(rng, 5, 150)
    check(spark, long + [(3, *r[1:]) for r in long[:70]] + [(9, *r[1:]) for r in long[:71]] + [(10, 0, "user", "word " * 200_000)])


def test_conversations_without_turns(spark):
    turns = hashed(spark.createDataFrame([(4, 0, "user", "a b")], "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in nodes(turns, spark.createDataFrame([(1,), (2,), (4,)], "conv_id long")).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(1, 0, None, 3, 1, 1, 0, sha("1,2")), (4, 1, 1, 1, 0, 1, 0, sha("4"))]
    none = turns.filter("conv_id < 0")
    assert nodes(none, none.select("conv_id")).count() == 0
    only = nodes(none, spark.createDataFrame([(8,)], "conv_id long")).collect()
    assert [tuple(r) for r in only] == [(8, 0, None, 1, 0, 1, 0, sha("8"))]


def test_blocks_cover_each_turn_once(spark):
    rows = [(1, t, "user", str(t)) for t in range(10)]
    cut = blocks(hashed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 4).collect()
    assert [(len(r["words"]), r["level"], r["before"], r["ended"]) for r in cut] == [(4, 0, 0, False), (4, 1, 4, False), (2, 2, 8, True)]
